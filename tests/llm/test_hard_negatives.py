import random
from collections import Counter
from math import floor, isfinite

import numpy as np
from pyspark.sql import functions as F

from kbspark.llm import hard_negatives
from kbspark.llm.hard_negatives import Tree, mine_hard_negatives

KIND = "vec_id long, embedding array<double>, label int"
MOST = (1 << 63) - 1


def brute(rows, every, positives=5, negatives=5):
    used = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v):
            used.append((i, [int(max(-(2.0**53), min(2.0**53, floor(x * 256)))) if abs(x) < 1e300 else int(np.sign(x)) * 2**53 for x in v], label))
    out = []
    for anchor, q, label in used:
        if anchor % every:
            continue
        all_ = sorted((-max(-MOST, min(MOST, sum(a * b for a, b in zip(q, v)))), i, other) for i, v, other in used if i != anchor)
        for score, i, _ in [x for x in all_ if x[2] == label][:positives]:
            inside = [x for x in all_ if x[2] != label and 80 * -score <= 100 * -x[0] <= 100 * -score][:negatives]
            out += [(anchor, i, rank, n, -score, -s) for rank, (s, n, _) in enumerate(inside, 1)]
    return Counter(out)


def run(spark, rows, every=10):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as id", "2 as slot", "3 as anchor", "4 as v", "5 as place", "6 as rank")
    return Counter(map(tuple, mine_hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def vectors(rng, n, dim, labels):
    middle = rng.normal(size=(labels, dim))
    label = rng.integers(0, labels, n)
    return [(i, (middle[c] + rng.normal(size=dim) * rng.choice([0.05, 0.5])).tolist(), int(c) if rng.random() < 0.8 else int(rng.integers(labels))) for i, c in enumerate(label)]


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = vectors(rng, 700, 6, 4)
    rows += [(701, None, 1), (702, [0.1, None, 0.2], 1), (703, [float("nan")] * 6, 1), (704, [float("inf")] * 6, 2), (None, rows[0][1], 1), (705, rows[0][1], None)]
    rows += [(706, [0.5, 0.5], 1), (707, [], 2), (710, [], 1), (720, [0.3], 3), (708, [1.0] * 8, 1)]  # other lengths
    rows += [(30, [0.2] * 6, 0), (30, [0.2] * 6, 0), (31, [0.2] * 6, 1), (31, [0.2] * 6, 1), (32, [0.2] * 6, 0)]  # repeated rows and ids
    want = brute(rows, 10)
    assert run(spark, rows) == want and len(want) > 500
    # Deeper trees, small blocks and a sample of a few rows: other leaves, the same rows.
    for name, value in (("LEAF_ROWS", 4), ("BLOCK_ROWS", 64), ("SAMPLE_ROWS", 64)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert run(spark, rows) == want


def test_ties_and_one_vector_repeated(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rng = random.Random(2)
    rows = [(i, [0.5, -0.25, 0.125], i % 3) for i in range(300)] + [(i, [rng.choice([0.0, 0.5]), -0.25, rng.choice([0.1, 0.125])], rng.randrange(3)) for i in range(300, 500)]
    rows += [(500, [0.0, 0.0, 0.0], 7), (501, [0.5, 0.5, 0.5], 7), (510, [-0.5, 0.25, 0.0], 8), (511, [0.5, -0.25, 0.0], 8), (520, [0.1, 0.1, 0.1], 9)]
    assert run(spark, rows) == brute(rows, 10)


def test_huge_components_and_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-2, 17)).tolist(), int(rng.integers(2))) for i in range(120)] + [(120, [1e308, -1e308, 1.0], 0)]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == Counter() and run(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == Counter() and run(spark, [(10, None, 1)]) == Counter()


def test_siblings_out_of_reach_are_not_visited():
    """Tight clusters: nearly all subtrees are eliminated, none that holds a row of the window."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 8)) * 256
    x = np.floor(np.repeat(middles, 50, 0) + rng.normal(size=(1000, 8)) * 8)
    tree = Tree(x[rng.permutation(1000)[:400]], 200_000)

    def seen(at, rows, apart, nearest):
        tree.nodes[at].widen(x[rows], apart, nearest)

    leaf, s = tree.leaf_of(x, seen), x @ x.T
    low, high = np.sort(s, 1)[:, -10], s.max(1)
    reached = tree.search(x, low[:, None], high[:, None])
    for i in range(1000):
        assert reached[i, leaf[(s[i] >= low[i]) & (s[i] <= high[i])]].all()
    assert reached.mean() < 0.2
