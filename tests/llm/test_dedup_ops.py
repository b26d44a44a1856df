import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from kbspark.llm import exact_dedup, jaccard, line_dedup
from kbspark.llm.line_dedup import build_hash, lookup

ODD = [(1, "same"), (2, "same"), (2, "same"), (3, None), (4, ""), (None, "same"), (5, "same "), (None, None), (6, "x" * 300_000)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "'k' as key", "2 as keep_id", "'z' as kept", "3 as id", "4 as body", "5 as node")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, used = [], set()
    for i, t in rows:
        t = t or ""
        keep = max((x for x in groups[t] if x is not None), default=None)
        first = i == keep and t not in used
        used |= {t} if first else set()
        out.append((i, keep, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_whatever_the_hash(spark):
    for fn in (exact_dedup.md5_128, lambda t: F.length(t).cast("string").cast("binary"), lambda t: F.lit(b"1")):
        got = exact_dedup.exact_dedup(docs_of(spark, ODD), keep="largest", hash_fn=fn).collect()
        assert Counter(map(tuple, got)) == brute_exact(ODD)
        left = exact_dedup.distinct_texts(docs_of(spark, ODD), keep="largest", hash_fn=fn).select("doc_id", "text").collect()
        assert Counter((r.doc_id, r.text or "") for r in left) == Counter({(2, "same"): 1, (4, ""): 1, (5, "same "): 1, (6, "x" * 300_000): 1})
    small = {r.doc_id for r in exact_dedup.exact_dedup(docs_of(spark, ODD)).collect() if r.kept}
    assert small == {1, 3, 5, 6}
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        h1[: n // 3] = h1[:1] if n else h1[:0]  # halves may repeat, pairs do not
        assert sorted(lookup(build_hash(h1, h2), h1, h2)) == list(range(n))


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(-1 if i is None else i)
    bad = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in bad and bad[key(x)] != (-1 if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"a common line number {i} of the pool" for i in range(12)] + ["short", "", "\tTABBED and common Line of text \r", "é" * 20, " " * 30]
    rows = [(rng.choice([i, i, i // 2]), "\n".join(rng.choice(pool + [f"{i} own line {rng.random()}" for _ in range(3)]) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    rows += [(None, "\n".join(pool)), (7, None), (8, ""), (9, pool[0] * 9000)]
    got = line_dedup.dedup_lines(docs_of(spark, rows), keys_per_shard=16, probes_per_task=40).collect()
    assert Counter(map(tuple, got)) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    text = [(f"id{i % 90:03d}", t) for i, (_, t) in enumerate(rows)] + [(None, rows[0][1])]
    order = {k: i for i, k in enumerate(sorted({i for i, _ in text if i}))}
    got = line_dedup.dedup_lines(spark.createDataFrame(text, "doc_id string, text string"), keys_per_shard=64).collect()
    names = {v: k for k, v in order.items()}
    want = brute_lines([(order.get(i), t) for i, t in text])
    assert Counter(map(tuple, got)) == Counter({(names.get(i), *rest): n for (i, *rest), n in want.items()})


def test_line_dedup_of_a_long_document_is_linear(spark):
    lines = [f"a line of text that every one has, number {i}" for i in range(60_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i in range(3)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: (60_000, 60_000), 1: (60_000, 60_000), 2: (60_000, 0)} and time.time() - began < 60


def brute_jaccard(rows):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    seqs = [tuple(low(t)) for _, t in rows]
    sets = {s: ({s[k : k + 5] for k in range(len(s) - 4)} if len(s) >= 5 else {s} if s else set()) for s in seqs}
    distinct = list(sets)
    links, root = defaultdict(set), {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a].add(b)
                links[b].add(a)
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for (i, _), s in zip(rows, seqs):
        ids[find(s)].append(i)
    copies = Counter(seqs)
    return Counter((i, min((x for x in ids[find(s)] if x is not None), default=None), len(links[s]), copies[s], len(ids[find(s)])) for (i, _), s in zip(rows, seqs))


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows, n = [], 0
    for size in (1, 1, 2, 3, 30, 320):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(size):
            mine = list(base)
            for _ in range(rng.randint(0, 4)):
                mine[rng.randrange(len(mine))] = word()
            rows.append((n, " ".join(mine)))
            n += 1
    rows += [(n, rows[3][1].upper()), (n + 1, "one two"), (n + 2, "One  two\n"), (n + 3, None), (n + 4, " \t"), (None, "one two"), (5, rows[5][1]), (n + 5, "w " * 50_000)]
    got = jaccard.jaccard_join(docs_of(spark, rows)).select("doc_id", "class_id", "n_links", "n_copies", "class_size").collect()
    assert Counter(map(tuple, got)) == brute_jaccard(rows)
    left = jaccard.drop_near_copies(docs_of(spark, rows[:380]))
    assert left.columns[:2] == ["doc_id", "text"]
    want = {c for _, c, *_ in brute_jaccard(rows[:380])}
    assert {r.doc_id for r in left.collect()} == want
    assert jaccard.jaccard_join(docs_of(spark, [])).count() == 0


def test_components_of_texts_alike_in_part_are_dealt_by_bucket(spark, monkeypatch):
    # A chain: neighbours have a similarity of 0.7, so that they are no links but make long components.
    rng = random.Random(4)
    part = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(246)]
    rows = [(i, " ".join(part[i : i + 6])) for i in range(240)]
    rows += [(1000 + i, t + f" end{i}") for i, (_, t) in enumerate(rows[::7])] + [(2000, rows[0][1] + " another end"), (None, rows[9][1].upper())]
    dealt = []
    kept = jaccard._dealt
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "_dealt", lambda *a: dealt.append(kept(*a)) or dealt[-1])
    got = jaccard.jaccard_join(docs_of(spark, rows)).select("doc_id", "class_id", "n_links", "n_copies", "class_size").collect()
    assert Counter(map(tuple, got)) == brute_jaccard(rows)
    ways = dealt[0].groupBy("component").agg(F.count("key").alias("keyed"), F.max("blocks").alias("blocks"), F.countDistinct("node").alias("sets")).collect()
    assert any(r.keyed for r in ways) and all(r.blocks == 1 for r in ways if r.keyed)
    # Near copies of one text: their buckets would carry more than their component does.
    base = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(60)]
    got = jaccard.jaccard_join(docs_of(spark, rows)).select("doc_id", "class_id", "n_links", "n_copies", "class_size").collect()
    assert Counter(map(tuple, got)) == brute_jaccard(rows)
    assert dealt[1].where("key is not null").count() == 0 and dealt[1].agg(F.max("blocks")).first()[0] == 8


def test_pruning_keeps_what_reaches_the_threshold():
    needed = jaccard.least_matches(0.8, 1e-6, 24, 240)
    rng = np.random.default_rng(2)
    matches = (rng.random((20000, 240)) < 0.8).cumsum(1)
    lost = np.zeros(20000, bool)
    for n, least in needed:
        lost |= matches[:, n - 1] < least
    assert lost.mean() < 1e-3
