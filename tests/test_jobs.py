"""Sources, feeds, extraction, vectors, stories, limits: against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import evaluate as ev
from kbspark.operators import stories as st
from kbspark.operators import vectors as vec
from kbspark.operators.components import components
from kbspark.sources import extract, store
from kbspark.streaming import limits


def test_store_first_wins_and_exists(spark):
    rows = [("a", "u1", 1), ("a", "u2", 0), ("", "u3", 2), ("b", "u4", 3), (None, "u5", 4)]
    batch = spark.createDataFrame(rows, "data string, url string, arrival int").selectExpr("*", "'j' as job")
    got = {r.url: r.status for r in store.store_sources(batch).collect()}
    assert got == {"u1": "exists", "u2": "new", "u3": "failed", "u4": "new", "u5": "failed"}
    stored = store.store_sources(batch).where("data = 'b'")
    assert {r.url: r.status for r in store.store_sources(batch, stored).collect()}["u4"] == "exists"
    assert store.tally(store.store_sources(batch)).first().asDict() == {"job": "j", "n_new": 2, "n_exists": 1, "n_failed": 2}


def test_routes(spark):
    rows = [(b"text", "text/plain"), (b"\xff\xfe", "text/plain"), (b"x" * 1_000_001, "text/plain"), (b"p", "application/pdf"), (b"p", "image/png"), (None, "text/plain")]
    got = spark.createDataFrame(rows, "d binary, c string").select(store.route(F.col("d"), F.col("c"), F.lit("")).alias("r")).collect()
    assert [r.r for r in got] == ["text", "inert: not text", "actionable: too large", "actionable: pdf disabled", "attachment", "actionable: missing"]


FEEDS = {
    b'<rss version="2.0"><channel><title>t</title><item><link> u </link><title>a</title></item><item><title>x</title></item></channel></rss>': ([("u", "a")], None),
    b"<rss><channel><item><link>u</link></item></channel><channel><item><link>w</link><title>b</title></item></channel></rss>": ([("u", ""), ("w", "b")], None),
    b'<r:rss xmlns:r="urn:x"><channel><r:item><r:link>u</r:link></r:item></channel></r:rss>': ([("u", "")], None),
    b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="s"/><link href="u"/><title>a</title></entry></feed>': ([("u", "a")], None),
    b'{"items":[{"url":"u","title":5},{"url":""},{"title":"x"}]}': ([("u", "")], None),
    b'<!DOCTYPE x><rss><channel/></rss>': ([], "doctype refused"),
    b"<rss><channel/></rss>": ([], "no items"),
    b"<html/>": ([], "unknown root"),
    b"[1]": ([], "json without items"),
    b"nothing": ([], "not a feed"),
}


def test_feeds(spark):
    feeds = spark.createDataFrame([(str(i), data) for i, data in enumerate(FEEDS)], "feed_id string, data binary")
    got = extract.feed_items(feeds).collect()
    for i, (items, error) in enumerate(FEEDS.values()):
        mine = [r for r in got if r.feed_id == str(i)]
        assert [(r.url, r.title) for r in mine if r.url] == items and [r.error for r in mine if not r.url] == ([error] if error else [])


def test_extract(spark):
    pages = [
        ("<nav>n</nav><article>one <b>two</b><script>s</script></article><main>longer main text</main>", "text/html", "longer main text"),
        ("<p>a</p><aside>x</aside><article>open", "text/html", "a\nopen"),
        ("<main>out<article>in</article></main>", "text/html", "out\nin"),
        ("<nav><article>kept</article></nav>", "text/html", "kept"),
        ("<script>only</script>", "text/html; charset=nope", "<script>only</script>"),
        ("<p>plain", "text/plain", "<p>plain"),
        ("<main>aa<article>bb</article></main><article>aa\nbb</article>", "text/html", "aa\nbb"),
        ("<article>one</article><main>two</main>", "text/html", "one"),
        ("<article> </article><p>page", "text/html", "page"),
        ("<main>A</article>B", "text/html", "A"),
        ("<article>A<main>B</article>C</main>", "text/html", "A\nB\nC"),
    ]
    df = spark.createDataFrame([(i, c, h.encode()) for i, (h, c, _) in enumerate(pages)], "id int, content_type string, data binary")
    got = {r.id: r for r in extract.extract_text(df, "id").collect()}
    assert [got[i].data.decode() for i in range(len(pages))] == [x[2] for x in pages]
    assert [got[i].content_type for i in (0, 4, 5)] == ["text/markdown", "text/html; charset=nope", "text/plain"]


def test_extract_keeps_bytes_and_nulls(spark):
    df = spark.createDataFrame([(1, "image/png", b"\x89PNG\xff\x00"), (2, None, b"\xfe"), (3, "text/html", None)], "id int, content_type string, data binary")
    got = {r.id: (r.content_type, r.data) for r in extract.extract_text(df, "id").collect()}
    assert got == {1: ("image/png", b"\x89PNG\xff\x00"), 2: (None, b"\xfe"), 3: ("text/html", None)}


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 4000)] + [(i, 10_000 + i) for i in range(1, 3000)] + [(20_000, 20_001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(8), local_edges=1000).collect()}
    assert got == {x: 0 if x < 20_000 else 20_000 for e in edges for x in e}


def test_place_seeds_vector_candidates_and_texts(spark):
    rows = [("a1", "t1", "sa", [], "A", "first"), ("b2", "t2", "sb", [], "B", "second"), ("c3", "t3", "sc", ["k:v"], "C", "third")]
    df = spark.createDataFrame(rows, "digest string, fetched string, slug string, identifiers array<string>, title string, body string")
    near = spark.createDataFrame([("b2", "a1", 1), ("c3", "story:old", 1), ("c3", "gone", 2)], "digest string, other string, rank int")
    old = spark.createDataFrame([("old", "t0", [], "Old")], "story string, first_seen string, identifiers array<string>, title string")

    def judge(page, found):
        assert page.text in ("first", "second", "third") and (page.digest != "b2" or found == [st.Story("sa", "A", ["first"])])
        return found[0].name

    got = {r.digest: (r.story, r.action) for r in st.place(df, old, judge, near).collect()}
    assert got == {"a1": ("sa", "started"), "b2": ("sa", "joined"), "c3": ("old", "joined")}


def test_components_like_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    # The same with rounds: one task may finish ten edges at most.
    again = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), local_edges=10).collect()}
    assert again == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sequential(rows, judge):
    """All summaries in one sequence."""
    stories, out = {}, {}
    for digest, fetched, slug, ids in sorted(rows, key=lambda r: (r[1], r[0])):
        forms = set(ids)
        shared = {n: len(forms & s["forms"]) for n, s in stories.items() if forms & s["forms"]}
        names = sorted(shared, key=lambda n: (-shared[n], stories[n]["first"], n))
        name = judge(st.Page(digest, "", ""), [st.Story(n, "", []) for n in names]) if names else None
        if not name:
            name = slug if slug not in stories else f"{slug}-{digest[:8]}"
        s = stories.setdefault(name, {"first": fetched, "forms": set()})
        s["first"], s["forms"] = min(s["first"], fetched), s["forms"] | forms
        out[digest] = name
    return out


@pytest.mark.parametrize("picky", [False, True])
def test_placing_by_component_equals_one_sequence(spark, picky):
    judge = (lambda page, found: found[-1].name if page.digest[0] < "8" else None) if picky else st.first_candidate
    rng = random.Random(12)
    rows, group = [], []
    for g in range(40):  # forty separate corpora in one table
        for i in range(rng.randint(1, 9)):
            ids = [f"k:{g}-{rng.randint(0, 6)}" for _ in range(rng.randint(0, 3))]
            rows.append((f"{rng.getrandbits(64):016x}", f"t{rng.randint(0, 3)}", f"s{rng.randint(0, 60)}", ids))
    df = spark.createDataFrame(rows, "digest string, fetched string, slug string, identifiers array<string>")
    assert {r.digest: r.story for r in st.place(df, judge=judge).collect()} == sequential(rows, judge)


def test_search_is_exact_and_prefilters(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(f"v{i:03d}", "ab"[i % 2], x[i].tolist()) for i in range(200)] + [("zero", "a", [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "name string, kind string, embedding array<float>")
    asked = vectors.limit(10).select(F.col("name").alias("query"), "kind", "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in vec.search(vectors, asked, 3).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("top")).collect():
        i = int(r.query[1:])
        same = [j for j in range(200) if j % 2 == i % 2]
        want = sorted(same, key=lambda j: -float(unit[i] @ unit[j]))[:3]
        assert [int(t["name"][1:]) for t in r.top] == want


def test_limits():
    fixed, sliding = limits.FixedWindow(2, 60), limits.SlidingWindow(2, 60)
    assert [fixed.step(t) for t in (0, 1, 2, 59.5, 60, 61)] == [(True, 0), (True, 0), (False, 58), (False, 1), (True, 0), (True, 0)]
    assert [sliding.step(t) for t in (0, 1, 2, 60, 60.5, 61)] == [(True, 0), (True, 0), (False, 58), (True, 0), (False, 1), (True, 0)]
    assert limits.SlidingWindow(0, 60).step(5) == (False, 60)


@pytest.mark.parametrize("kind", [limits.FixedWindow, limits.SlidingWindow])
def test_limit_stream_equals_batch(spark, tmp_path, kind):
    rng = random.Random(5)
    rows = [(rng.randint(0, 5), round(rng.random() * 500, 3), i) for i in range(300)]
    log = spark.createDataFrame(rows, "client long, ts double, id long")
    batch = {(r.client, r.ts): (r.admitted, r.retry_after) for r in limits.limit_log(log, kind, 3, 60.0).collect()}
    want = {}
    for c in range(6):
        one = kind(3, 60.0)
        want |= {(c, t): one.step(t) for _, t, _ in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])}
    assert batch == want
    # Calls come up to a minute late: dealt to batches by a time that is moved, and shuffled inside each.
    late = [(c, int(round(t * 1e6)), i, int((t + rng.random() * 60) // 120)) for c, t, i in rows]
    rng.shuffle(late)
    for batch in range(6):
        some = [r[:3] for r in late if r[3] == batch]
        if some:
            spark.createDataFrame(some, "client long, us long, id long").coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
    got = {(r.client, r.us / 1e6): (r.admitted, r.retry_after) for r in limits.limit_files(spark, str(tmp_path / "in"), kind, 3, 60.0, "61 seconds").collect()}
    assert got == want


def test_limit_stream_drops_what_is_too_late(spark, tmp_path):
    calls = [[(1, 100_000_000, 0)], [(1, 500_000_000, 1)], [(1, 90_000_000, 2), (1, 501_000_000, 3)]]
    for i, some in enumerate(calls):
        spark.createDataFrame(some, "client long, us long, id long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    got = {r.id: r.admitted for r in limits.limit_files(spark, str(tmp_path / "in"), limits.SlidingWindow, 1, 60.0, "10 seconds").collect()}
    assert got == {0: True, 1: True, 3: False}


def test_parse_labels(spark):
    df = spark.createDataFrame([('```json\n["a","x","a"]\n```',), ('["b"]',), ("no",)], "r string")
    got = df.select(ev.parse_labels(F.col("r"), F.array(F.lit("a"), F.lit("b"))).alias("y")).collect()
    assert [r.y for r in got] == [["a", "a"], ["b"], []]


def test_only_an_empty_text_embeds_to_zeros():
    import zlib

    import pandas as pd

    # Two words that meet in one place with opposite signs.
    words = {}
    for w in (f"w{i}" for i in range(5000)):
        h = zlib.crc32(w.encode())
        words.setdefault((h % vec.DIM, h >> 16 & 1), w)
    cancel = next(f"{words[p, 0]} {words[p, 1]}" for p in range(vec.DIM) if (p, 0) in words and (p, 1) in words)
    found = vec.default_embed(pd.Series([cancel, " \n", "word", "", None]))
    assert [any(x) for x in found] == [True, True, True, False, False]


def test_blocks_are_packed_once(spark):
    """Where blocks meet, nothing is packed: one Python worker a task."""
    vectors = spark.range(40).select(F.concat(F.lit("v"), "id").alias("name"), F.lit("a").alias("kind"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    found = vec.nearest(vectors, vectors.limit(5).withColumnRenamed("name", "query"), 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_relevant_counts_with_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vec, "HELD_SCORES", 300)
    monkeypatch.setattr(vec, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, size=(90, 3)).astype(float)  # most scores are tied
    kinds = [None if i % 11 == 3 else "abc"[i % 3] for i in range(90)]
    rows = [(f"v{i}", kinds[i], 90 - i, i % 4 == 0, x[i].tolist()) for i in range(90)]
    vectors = spark.createDataFrame(rows, "name string, kind string, pos long, short_stub boolean, embedding array<double>")
    got = {r["query"]: r.asDict() for r in vec.relevant_counts(vectors, vectors.where("pos % 5 = 0").withColumnRenamed("name", "query")).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {}
    for q in (i for i in range(90) if (90 - i) % 5 == 0 and kinds[i]):
        order = sorted((j for j in range(90) if j != q), key=lambda j: (-round(float(unit[q] @ unit[j]), 12), 90 - j))
        ranks = [(r, j) for r, j in enumerate(order, 1) if kinds[j] == kinds[q]]
        short, long = ([r for r, j in ranks if (j % 4 == 0) is s] for s in (True, False))
        under = sum(float(unit[q] @ unit[j]) < 0.5 for j in order[:10])
        want[f"v{q}"] = {"query": f"v{q}", "n": len(ranks), "at5": sum(r <= 5 for r, _ in ranks), "at10": sum(r <= 10 for r, _ in ranks), "first": ranks[0][0], "short_sum": sum(short), "short_n": len(short), "long_sum": sum(long), "long_n": len(long), "under": under}
    assert got == want


def test_limit_state_is_called_by_groups(spark, tmp_path, monkeypatch):
    """Many clients cost few state calls, a client of no name is one of its own, and states outlive batches."""
    monkeypatch.setattr(limits, "GROUPS", 3)
    rng = random.Random(8)
    rows = [(None if (c := rng.randint(0, 60)) == 7 else c * 10**16 + 1, rng.randint(0, 10**9), i) for i in range(900)]
    for batch in range(3):
        some = [r for r in rows if r[1] * 3 // (10**9 + 1) == batch]
        spark.createDataFrame(some, "client long, us long, id long").coalesce(1).write.parquet(str(tmp_path / f"in/{batch}"))
    asked = limits.limit_stream(spark.readStream.schema("client long, us long, id long").parquet(str(tmp_path / "in/0")), limits.SlidingWindow, 2, 90.0, "1 second")
    assert "group" in asked._jdf.queryExecution().logical().toString()
    got = {r.id: (r.client, r.admitted, r.retry_after) for r in limits.limit_files(spark, str(tmp_path / "in"), limits.SlidingWindow, 2, 90.0, "1 second").collect()}
    want, state = {}, {}
    for c, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = (c, *state.setdefault(c, limits.SlidingWindow(2, 90.0)).step(us / 1e6))
    assert got == want


def test_placing_without_a_judge_takes_the_first_candidate(spark):
    rng = random.Random(5)
    rows = [(f"{rng.getrandbits(64):016x}", f"t{rng.randint(0, 9)}", f"s{rng.randint(0, 90)}", [f"k:{rng.randint(0, 25)}" for _ in range(rng.randint(0, 5))]) for _ in range(150)]
    df = spark.createDataFrame(rows, "digest string, fetched string, slug string, identifiers array<string>")
    old = [(f"s{i}", f"t{rng.randint(3, 9)}", [f"k:{rng.randint(0, 25)}" for _ in range(4)]) for i in range(0, 60, 3)]
    old = spark.createDataFrame(old, "story string, first_seen string, identifiers array<string>")
    got = {tuple(r) for r in st.place(df, old).select("digest", "story", "action").collect()}
    assert got == {tuple(r) for r in st.place(df, old, st.first_candidate).select("digest", "story", "action").collect()} and len(got) == 150


def test_the_leading_story_needs_no_list_of_candidates(monkeypatch):
    shelf = st._Shelf()
    monkeypatch.setattr(st._Shelf, "candidates", None)
    for i in range(50):
        shelf.admit(f"s{i}", {"story": f"s{i}", "digest": f"story:s{i}", "fetched": f"t{90 - i}", "forms": ["k:hot", f"k:{i % 7}"]})
    assert shelf.place({"story": "", "digest": "d", "fetched": "t10", "slug": "n", "forms": ["k:hot", "k:3"]}, None)[1:3] == ("s45", "joined")
    # Its first time is now the earliest of all that hold the hot form.
    assert shelf.place({"story": "", "digest": "e", "fetched": "t11", "slug": "n", "forms": ["k:hot"]}, None)[1:3] == ("s45", "joined")


def test_only_nodes_of_several_pieces_go_on(spark, monkeypatch):
    from kbspark.operators import components as c

    edges = [(100 * p + i, 100 * p + i + 1) for p in range(8) for i in range(50)] + [(700, 5000), (100, 5000)]
    df = spark.createDataFrame(edges, "a long, b long").repartitionByRange(4, "a")
    sizes = []
    monkeypatch.setattr(c, "materialise", lambda x, real=c.materialise: sizes.append(real(x)) or sizes[-1])
    got = {r.node: r.component for r in c.components(df, local_edges=20).collect()}
    assert got == {x: 100 if x >= 700 or 100 <= x < 200 else x // 100 * 100 for e in edges for x in e}
    assert sizes[0].count() > 400 and max(x.count() for x in sizes[1:]) < 50
