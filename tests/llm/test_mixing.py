import random

from kbspark.llm.mixing import emit_mix, mix_sources, targets


def fill(sizes, weights=(5, 2, 1), most=3):
    """Share, stop, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = total - sum(done.values())
        free = [s for s in names if s not in done]
        if not free:
            return done
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return done | share
        done |= {s: most * sizes[s] for s in over}


def test_targets_fill_like_resharing(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 100, 1000, 50000]) for s in ["a", "B", "é", "", "z9", None, "m"][: rng.randint(1, 7)]}
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) <= 1e-6 * max(1, want[s])


def test_mix_takes_near_target_and_never_over_three(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), ["x", "y", None][i % 3 if i % 5 else 0]) for i in range(3000)] + [(None, None, "x"), (7, "a b", "x"), (7, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'c' as rate")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    for s in ("x", "y", None):
        mine = [r for r in got if r.source == s]
        spread = sum(r["size"] ** 2 for r in mine) ** 0.5 / 2
        assert abs(sum(r.taken for r in mine) - mine[0].target) < spread
        assert all(0 <= r.taken <= 3 * r["size"] for r in mine)
        assert sum(r["size"] for r in mine) == mine[0].source_size
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))
    emitted = emit_mix(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in got)


def test_small_sources_come_near_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * (rng.choice([3, 20, 90]) if i % 50 else 300), f"s{i % 8}") for i in range(400)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) / mine[0].target - 1) < 0.2


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 0 and emit_mix(docs).count() == 0
