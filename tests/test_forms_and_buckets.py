from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kbspark.operators import forms as fm
from kbspark.operators import stories as st
from kbspark.operators import vectors as vec
from kbspark.operators.vector_table import VectorTable


def holders(n, prefix, every):
    return [(f"{prefix}{i}", "k", f) for i in range(n) for f in (["hot"] + (["warm"] if i % 2 else []) + [f"f{i % every}"])]


def test_hot_forms_give_the_same_pairs(spark, monkeypatch):
    left, right = holders(300, "d", 50), holders(90, "s", 70)
    want = Counter()
    for d, _, f in left:
        for s, _, g in right:
            want[d, s] += f == g
    want = {p: n for p, n in want.items() if n}
    ldf, rdf = spark.createDataFrame(left, "digest string, key string, norm string"), spark.createDataFrame(right, "story string, key string, norm string")
    monkeypatch.setattr(fm, "CLASS_BLOCK", 16)
    for heavy in (1 << 20, 1000, 4):
        got = fm.shared(ldf, rdf, heavy_pairs=heavy).collect()
        assert {(r.digest, r.story): r.shared for r in got} == want and len(got) == len(want)
    lists = fm.shared(ldf, rdf, lists=True, heavy_pairs=1000).collect()
    assert {(r.digest, r.story): len(r.shared) for r in lists} == want
    assert {f.norm for r in lists if (r.digest, r.story) == ("d1", "s1") for f in r.shared} == {"hot", "warm", "f1"}


def test_no_task_gets_a_whole_hot_form(spark, monkeypatch):
    """A form on every row: no key of the last join has more rows than a block of either side."""
    monkeypatch.setattr(fm, "CLASS_BLOCK", 16)
    n, m = 400, 200
    ldf = spark.range(n).select(F.concat(F.lit("d"), "id").alias("digest"), F.lit("k").alias("key"), F.lit("hot").alias("norm"))
    rdf = spark.range(m).select(F.concat(F.lit("s"), "id").alias("story"), F.lit("k").alias("key"), F.lit("hot").alias("norm"))
    sizes = []
    monkeypatch.setattr(fm, "materialise", lambda df, real=fm.materialise: sizes.append(df) or real(df))
    assert fm.shared(ldf, rdf, heavy_pairs=100).count() == n * m
    blocks = next(df for df in sizes if "l_block" in df.columns).select("l_block", "r_block").distinct().count()
    assert blocks == -(-n // 16) * -(-m // 16)


def test_index_by_batches(spark, tmp_path):
    rows = [("a", ["Term:  Straße x", "term:B"]), ("b", ["term:b", "isbn:１２"]), ("c", [])]
    df = spark.createDataFrame(rows, "digest string, identifiers array<string>")
    for batch in (0, 1, 1):
        fm.write_index(fm.forms(df.where(f"digest {'=' if batch == 0 else '<>'} 'a'"), "digest"), str(tmp_path / "i"), batch)
    got = {tuple(r) for r in fm.read_index(spark, str(tmp_path / "i"), "digest").collect()}
    assert got == {("a", "Term", "strasse x"), ("a", "term", "b"), ("b", "term", "b"), ("b", "isbn", "12")}
    assert {r.digest for r in fm.read_index(spark, str(tmp_path / "i"), "digest", before=1).collect()} == {"a"}
    index = fm.read_index(spark, str(tmp_path / "i"), "digest")
    pairs = st.candidate_pairs(index, index.withColumnRenamed("digest", "story"))
    plan = pairs._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rlike" not in plan
    assert {tuple(r) for r in pairs.where("digest < story").collect()} == {("a", "b", 1)}


def test_a_judge_that_names_no_candidate(spark):
    df = spark.createDataFrame([("a1", "t1", "s", ["k:v"]), ("b2", "t2", "u", ["k:v"])], "digest string, fetched string, slug string, identifiers array<string>")
    got = {r.digest: (r.story, r.action) for r in st.place(df, judge=lambda page, found: "no-such-story").collect()}
    assert got == {"a1": ("s", "started"), "b2": ("u", "started")}
    near = spark.createDataFrame([("b2", "a1", 1)], "digest string, other string, rank int")
    alone = df.withColumn("identifiers", F.array(F.concat(F.lit("k:"), "digest")))
    assert {r.story for r in st.place(alone, near=near).collect()} == {"s", "u"}  # no judge: nearness joins nothing
    assert {r.story for r in st.place(alone, judge=st.first_candidate, near=near).collect()} == {"s"}


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "name string, text string").select("name", F.lit("k").alias("kind"), F.col("name").alias("title"), F.md5(F.col("text").cast("binary")).alias("embed_hash"), "text")


def test_a_sweep_writes_only_what_changed(spark, tmp_path):
    rows = [(f"p{i}", f"words {i}") for i in range(200)]
    table = VectorTable(spark, str(tmp_path / "v"), buckets=8)
    table.create(vec.sweep(pages_of(spark, rows), spark.createDataFrame([], "name string, kind string, title string, embed_hash string, embedding array<float>")))
    assert table.sweep(pages_of(spark, rows)) == set() and table.manifest()[0] == 1
    rows[7] = ("p7", "other words")
    touched = table.sweep(pages_of(spark, rows))
    assert len(touched) == 1 and [p.name for p in Path(tmp_path / "v/data/version=2").glob("bucket=*")] == [f"bucket={next(iter(touched))}"]
    got = {r.name: (r.embed_hash, tuple(r.embedding)) for r in table.read().collect()}
    again = pages_of(spark, rows).withColumn("embedding", vec.embedded(F.col("text")))
    assert got == {r.name: (r.embed_hash, tuple(r.embedding)) for r in again.collect()}
    left = rows[:3]  # most pages vanish, buckets may be empty
    table.sweep(pages_of(spark, left))
    assert {r.name for r in table.read().collect()} == {"p0", "p1", "p2"}
    # A sweep that died before its manifest changes nothing.
    table._write(table.manifest()[0] + 1, table.read().limit(1))
    assert table.read().count() == 3
    table.sweep(pages_of(spark, []))
    assert table.read().count() == 0 and table.sweep(pages_of(spark, left)) and table.read().count() == 3


def test_vectors_must_fit(spark):
    import pandas as pd

    df = spark.createDataFrame([("a",), ("bb",)], "t string").coalesce(1)
    for bad, said in ((lambda x: x.map(lambda v: [0.0] * len(v)), "dimensions"), (lambda x: pd.Series([[1.0]]), "vectors for")):
        with pytest.raises(Exception, match=said):
            df.select(vec.embedded(F.col("t"), bad)).collect()


def test_clustered_search_is_exact_and_skips(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vec, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(vec, "SAMPLE_ROWS", 150)
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 6))
    rows = [(f"v{i:03d}", "ab"[i % 2], (middles[i % 12] + rng.normal(size=6) * 0.03).tolist()) for i in range(600)]
    rows += [("zero", "a", [0.0] * 6), ("zero2", "b", [0.0] * 6), ("v000x", "a", rows[0][2]), ("v000y", "a", rows[0][2])]
    vectors = spark.createDataFrame(rows, "name string, kind string, embedding array<double>")
    asked = vectors.where("name like 'v0%5' or name in ('zero', 'v000')").select(F.col("name").alias("query"), F.when(F.col("name") > "v05", F.col("kind")).alias("kind"), "embedding")
    clusters = vec.Clusters(vectors)
    for k in (1, 5, 60):
        got, report = vec.search_clusters(clusters, asked, k)
        want = {(r.query, r.rank): r.name for r in vec.search(vectors, asked, k).collect()}
        assert {(r.query, r.rank): r.name for r in got.collect()} == want
        counts = report.first()
        assert counts.met > 100 and (counts.skipped > counts.met / 2 or k == 60)
    none = vec.Clusters(vectors.limit(0))
    assert vec.search_clusters(none, asked, 3)[0].count() == 0


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    left, right = holders(200, "d", 50), holders(60, "s", 70)
    ldf, rdf = spark.createDataFrame(left, "digest string, key string, norm string"), spark.createDataFrame(right, "story string, key string, norm string")
    want = fm.shared(ldf, rdf).collect()
    monkeypatch.setattr(fm, "TASK_PAIRS", 100)
    found = fm.shared(ldf, rdf)
    assert found.rdd.getNumPartitions() > 100 and sorted(found.collect()) == sorted(want)
    assert sorted(fm.shared(ldf, rdf, heavy_pairs=1000).collect()) == sorted(want)


def shuffled(spark, since=0):
    """(rows shuffled by stages from `since` on, the next stage's number)."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    found = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in found if s.stageId() >= since), max([s.stageId() for s in found], default=-1) + 1


@pytest.mark.parametrize("heavy", [1 << 20, 1000])
def test_no_pair_is_shuffled(spark, heavy):
    """Digests and forms go to where pairs are made; the pairs stay, also when they are ranked."""
    left, right = holders(400, "d", 50), holders(200, "s", 70)
    ldf, rdf = spark.createDataFrame(left, "digest string, key string, norm string"), spark.createDataFrame(right, "story string, key string, norm string")
    ranges = rdf.select("story", F.lit("").alias("first_seen")).distinct()
    since = shuffled(spark)[1]
    lists = fm.shared(ldf, rdf, lists=True, heavy_pairs=heavy).collect()
    placed = st.ordered_candidates(fm.shared(ldf, rdf, heavy_pairs=heavy, dealt=True), F.broadcast(ranges)).collect()
    assert len(lists) == len(placed) == 400 * 200
    assert shuffled(spark, since)[0] < 400 * 200 / 4
    assert {(r.digest, r.story): len(r.shared) for r in lists} == {(r.digest, r.story): r.shared for r in placed}
    assert all(f.key == "k" for r in lists for f in r.shared) and all(list(r.shared) == sorted(r.shared) for r in lists)


def test_blocks_of_few_hold_whole_blocks_of_many(spark):
    """A story's list goes to each deal once, not to each deal for each block of digests."""
    rows = spark.range(5000).select(F.concat(F.lit("d"), "id").alias("digest"))
    got = rows.select(fm._block("digest", F.lit(7)).alias("few"), fm._block("digest", F.lit(40)).alias("many"))
    assert got.distinct().count() <= 7 + 40 and {r.few for r in got.select("few").distinct().collect()} == set(range(7))


def test_recheck_looks_at_few_stories(spark):
    rows = [("a", None, ["s1", "s2"]), ("b", None, ["s1", "s3"]), ("c", None, []), ("d", None, ["s9"]), ("e", "t", None), ("f", None, None)]
    old = spark.createDataFrame([(d, t, "T", seen) for d, t, seen in rows], "digest string, target string, target_title string, seen array<string>")
    stories = spark.createDataFrame([("t", "T")], "story string, title string")
    held = spark.createDataFrame([("a", "k", "x"), ("b", "k", "x"), ("c", "k", "none"), ("d", "k", "hot"), ("f", "k", "x")], "digest string, key string, norm string")
    told = spark.createDataFrame([("s1", "k", "x"), ("s2", "k", "x")] + [(f"s{i}", "k", "hot") for i in range(9, 40)], "story string, key string, norm string")
    got = {r.digest: r.holds for r in st.recheck(old, stories, held, told).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": False}


def test_light_summaries_are_summaries_without_a_join(spark, tmp_path):
    from kbspark.plans import views as v

    texts = ["Title one\nwith aSomewhatLongishWord", "Title one\nwith aSomewhatLongishWord", "", None, "ab.12@mail3.example.com x", "ab.12@mail3.example.com x"]
    docs = [(i, x, "en", "src1") for i, x in enumerate(texts[:5])] + [(None, texts[5], "en", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    light = v.light(spark, str(tmp_path))
    columns = ["title", "identifiers", "arrival", "fetched"]
    got = [tuple(r) for r in light.select("digest", *columns).orderBy("digest").collect()]
    want = v.summaries(spark, str(tmp_path)).where("arrival is not null").select("source", *columns).orderBy("source")
    assert got == [tuple(r) for r in want.collect()] and {r[3] for r in got} == {0, 4}
    assert "Join" not in light._jdf.queryExecution().optimizedPlan().toString()


def test_pushes_are_matched_once_a_class(spark, monkeypatch):
    """Agents of the same forms: the rows of all, in blocks, from one match each."""
    summaries = [(f"d{i}", [f"k:{i % 3}", f"K:{i % 3}", "k:Hot", "k:hot"][: 1 + i % 4]) for i in range(90)]
    agents = [(f"a{i}", ["k:HOT"] if i % 2 else ["k:1", "k:hot"]) for i in range(60)]
    want = Counter()
    for d, ids in summaries:
        for a, held in agents:
            said = sorted({x for x in ids if (x.split(":")[0], x.lower().split(":")[1]) in {("k", y.lower().split(":")[1]) for y in held}})
            want.update([(d, a, tuple(said))] if said else [])
    sdf = spark.createDataFrame(summaries, "digest string, identifiers array<string>")
    adf = spark.createDataFrame(agents, "name string, identifiers array<string>")
    monkeypatch.setattr(fm, "TASK_PAIRS", 64)
    sizes = []
    monkeypatch.setattr(st, "shared", lambda *x, real=st.shared, **y: sizes.append(real(*x, **y)) or sizes[-1])
    got = st.push_matches(sdf, adf)
    assert Counter((r.digest, r.name, tuple(r.shared)) for r in got.collect()) == want
    assert sizes[0].select("story").distinct().count() == 2


@pytest.fixture
def hot_word(spark, tmp_path):
    """(folder, texts by id, stories) of 300 texts, one of them 700 times, that share a word with each of some 300 stories; nothing is small enough to be broadcast unasked."""
    texts = {i * 360: f"Title {i}\nsomehotlongword " + (f"word{'abcdefghij'[i % 10] * 12} " if i % 3 else "") + "x" * (i % 17) for i in range(300)}
    texts |= {(300 + i) * 360 + 60: texts[360] for i in range(700)}
    docs = [(i, x, "en", f"src{i // 360 % 7}") for i, x in texts.items()]
    docs += [(1, "", "en", "src1"), (2, None, "en", None), (None, "No number\nsomehotlongword", "en", "src1"), (61, "Without a candidate\nsomecoldlongword", "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_no_candidate_is_shuffled_to_the_judge(spark, hot_word, monkeypatch):
    """The judge sees each summary's title, text and stories in order; bodies go to the candidates, once a text, and no pair goes anywhere."""
    from kbspark.plans import model_queries, story_queries
    from kbspark.plans import views as v

    order = story_queries.candidate_order(spark, hot_word).collect()
    titles = {r.stem: r.title for r in v.stories(spark, hot_word).collect()}
    found = {}
    for r in sorted(order, key=lambda r: (r.digest, r.place)):
        found.setdefault(r.digest, []).append(r.story)
    pick = lambda title, text, names, told: names[len(f"{title}{text}{told[len(names) // 2]}") % len(names)]
    pages = {r.source: (r.title, r.body) for r in v.summaries(spark, hot_word).collect()}
    want = {d: pick(*pages[d], names, [titles[n] for n in names]) for d, names in found.items()}
    assert len(want) == 301 and len(order) > 80_000 and len(set(want.values())) > 10

    monkeypatch.setattr(model_queries.models, "first_candidate", lambda page, found: pick(page.title, page.text, [s.name for s in found], [s.title for s in found]))
    since = shuffled(spark)[1]
    got = model_queries.judge_fn(spark, hot_word).collect()
    assert shuffled(spark, since)[0] < len(order) / 4
    assert {r.digest: r.story for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["candidate_order", "judge"])
def test_no_pair_is_joined_with_its_story(spark, hot_word, name):
    from kbspark.plans import story_queries

    since = shuffled(spark)[1]
    rows = story_queries.QUERIES[name](spark, hot_word).collect()
    assert len(rows) > (80_000 if name == "candidate_order" else 300)
    assert shuffled(spark, since)[0] < 80_000 / 4


def test_bodies_ask_for_deals_of_their_own(spark):
    rows = spark.createDataFrame([("d1", "k", "f"), ("d2", "k", "g")], "digest string, key string, norm string")
    deals = fm.deal_out(rows, rows.withColumnRenamed("digest", "story"), least=50)
    assert deals.parts == 50 and deals.heavy is None
    assert deals.dealt(rows).rdd.getNumPartitions() == 50 and {r.deal for r in deals.dealt(rows).collect()} == {r.deal for r in rows.select(deals.of()).collect()}
    assert sorted(tuple(r) for r in fm.shared(rows, rows.withColumnRenamed("digest", "story"), deals=deals).collect()) == [("d1", "d1", 1), ("d2", "d2", 1)]
