import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from kbspark.llm import minmax
from kbspark.llm.minmax import MinMax, minmax_dedup


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter(pair for held in holders.values() for pair in itertools.combinations(held, 2))
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [d for d in least[find(i)] if d is not None]
        component = min(known) if known else None
        out.append((doc, len(sets[i]), component, doc == component))
    return Counter(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as node", "4 as component_id", "5 as kept", "6 as body")
    return Counter(map(tuple, minmax_dedup(df).collect()))


def words(rng, n):
    return [f"w{rng.randrange(2000)}" for _ in range(n)]


def changed(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


def test_components_are_those_of_all_links(spark):
    rng, rows = random.Random(1), []
    for _ in range(25):  # families around the threshold: links to the base, to one another, chains
        base = words(rng, rng.choice([4, 8, 30, 200]))
        rows += [" ".join(changed(rng, base, rng.randrange(0, max(2, len(base) // 30)))) for _ in range(6)]
        for _ in range(4):
            base = changed(rng, base, max(1, len(base) // 60))
            rows.append(" ".join(base))
    rows += [" ".join(words(rng, n)) for n in (1, 2, 2, 3, 50)]
    rows = [(i, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "a b"), (906, "A  B\n"), (None, "a b"), (None, "alone here now"), (None, None)]
    rows += [(907, "same words again and again"), (907, "same words again and again"), (908, "again and again and again and again"), (909, "and again and again")]
    rows += [(910, " ".join(words(rng, 60_000))), (911, "y" * 400_000), (912, "Y" * 400_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()


def test_large_group_without_a_common_hub(spark, monkeypatch):
    """Blocks of a few sets: members of one bucket that are no copies of its least node meet all the same."""
    monkeypatch.setattr(minmax, "BLOCK_SETS", 4)
    monkeypatch.setattr(minmax, "HUB_SETS", 4)
    rng = random.Random(2)
    base = words(rng, 300)
    rows = [(i, " ".join(changed(rng, base, rng.randrange(4, 14)))) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(10)]
    got = run(spark, rows)
    assert got == brute(rows) and len({c for _, _, c, _ in got}) > 1


def test_signature_ends_are_unbiased():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 150, dtype=np.uint64) << np.uint64(1)
    a, b = hashes[:120], hashes[30:]  # 90 of 150 in common
    sign = MinMax(4000)
    x, y = sign(np.concatenate([a, b]), np.array([len(a), len(b)]))
    low, high = x[:4000] == y[:4000], x[4000:] == y[4000:]
    assert abs(low.mean() - 0.6) < 0.03 and abs(high.mean() - 0.6) < 0.03
    assert np.cov(low, high)[0, 1] < 0.01  # the ends do not repeat one another
