import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from kbspark.functions.models import default_summarize
from kbspark.operators import seen
from kbspark.operators import stories as st
from kbspark.streaming import ingest
from kbspark.streaming.ingest import Models, Tables, ingest_batch

KIND = "arrival long, data string, url string, fetched string, content_type string, job string"


def fetched(i):
    return f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00Z"


def documents(n):
    rng = random.Random(6)
    long = ["".join(rng.choice("abcdefgh") for _ in range(15)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = f"Report {rng.randrange(n // 2)} of day. " + " ".join(rng.sample(long, rng.randrange(0, 3))) + f". End {i}."
        kind = rng.choice(["text/plain"] * 6 + ["image/png", "application/pdf"])
        rows.append((i, text, f"https://x.org/{i}", fetched(i), kind, f"j{i % 3}"))
    rows[5] = (5, rows[2][1], "https://y.org", fetched(5), "text/plain", "j0")  # seen in its batch
    rows[n - 3] = (n - 3, rows[1][1], "https://z.org", fetched(n - 3), "text/plain", "j0")  # seen in an earlier one
    rows[7] = (7, "", "https://x.org/7", fetched(7), "text/plain", "j1")
    rows[8] = (8, "??? !!! ;", "https://x.org/8", fetched(8), "text/plain", "j1")  # a reply without title
    rows[9] = (9, None, "https://x.org/9", fetched(9), None, None)
    return rows


def state(tables):
    return {
        "results": Counter(map(tuple, tables.read("results").drop("batch").collect())),
        "sources": Counter(map(tuple, tables.read("sources").drop("batch").collect())),
        "pages": Counter((r.name, r.digest, r.title, tuple(r.identifiers), r.body) for r in tables.read("pages").collect()),
        "dropped": Counter(map(tuple, tables.read("dropped").drop("batch").collect())),
        "vectors": Counter((r.name, r.embed_hash, tuple(r.embedding)) for r in tables.read("vectors").collect()),
        "placements": Counter((r.digest, r.story, r.action) for r in tables.read("placements").collect()),
        "stories": Counter((r.story, r.title, tuple(r.members), r.first_seen, r.last_seen, tuple(r.identifiers)) for r in tables.stories().collect()),
    }


def run(spark, path, batches, ask=None):
    tables = Tables(spark, path)
    tables.prepare()
    for number, rows in batches:
        ingest_batch(spark.createDataFrame(rows, KIND), number, path, ask)
    return state(tables)


def test_batches_and_a_repeat_equal_one_run(spark, tmp_path):
    rows = documents(60)
    whole = run(spark, str(tmp_path / "a"), [(0, rows)])
    parts = run(spark, str(tmp_path / "b"), [(0, rows[:35]), (1, rows[35:]), (1, rows[35:])])
    assert parts == whole
    assert max(len(s[2]) for s in whole["stories"]) > 2 and len(whole["stories"]) > 5
    reasons = {r[0]: r[6] for r in whole["results"]}
    assert reasons[7] == reasons[9] == "empty" and [r[4] for r in whole["results"] if r[0] in (5, 57)] == ["exists"] * 2
    drops = Counter(r[1] for r in whole["dropped"])
    assert drops["blank title"] == 1 and drops["attachment"] and drops["actionable: pdf disabled"]
    # Each member is in one story, and every page is placed.
    members = [d for s in whole["stories"] for d in s[2]]
    assert len(members) == len(set(members)) == sum(whole["pages"].values())
    # A batch of nothing but known sources changes outcomes only.
    again = run(spark, str(tmp_path / "b"), [(2, [(100 + r[0], *r[1:]) for r in rows[:5]])])
    assert {k: v for k, v in again.items() if k != "results"} == {k: v for k, v in parts.items() if k != "results"}
    assert Counter(r[4] for r in again["results"] - parts["results"]) == Counter(exists=5)


def test_stories_are_those_of_placing_all(spark, tmp_path):
    rows = documents(40)
    got = run(spark, str(tmp_path / "c"), [(0, rows[:25]), (1, rows[25:])])
    pages = Tables(spark, str(tmp_path / "c")).read("pages")
    want = Counter(map(tuple, st.place(pages).select("digest", "story", "action").collect()))
    assert got["placements"] == want


def test_judge_sees_near_stories(spark, tmp_path):
    """With a judge, stories near by vector are candidates, stored ones too; a made-up name is no join."""

    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [1.0, 0.0] if "cats" in x else [0.0, 1.0])

    def judge(page, found):
        return found[0].name if "cats" in page.title else "no-such-story"

    rows = [(i, f"{what} number {i}. Text.", f"u{i}", fetched(i), "text/plain", "j") for i, what in enumerate(["cats", "dogs", "cats", "dogs"])]
    got = run(spark, str(tmp_path / "d"), [(0, rows[:2]), (1, rows[2:])], Models(embed=embed, judge=judge))
    assert sorted((len(s[2]), s[1].split()[0]) for s in got["stories"]) == [(1, "dogs"), (1, "dogs"), (2, "cats")]


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    held = seen.words(keys.where("k % 2 = 0")).unionByName(seen.words(keys.where("k % 3 = 0")))
    out = {int(r.k): r.maybe for r in seen.flagged(keys, "k", held).collect()}
    assert all(out[k] for k in out if k % 2 == 0 or k % 3 == 0) and sum(out[k] for k in out if k % 2 and k % 3) < 10


ODD = [
    "", " ", "\n", ". ", " . ", "A. ", "A. B. ", "A. B. C", "Hello . World . Foo", "a.\tb.\r\nc. d", ". . . .", ".. ..", "abc.  ", "\x0b. a", "A.  . B. C",
    "one. two. three", "é" * 50, "\U0001f600" * 45 + " a", " \n\t" * 50 + "a" + " " * 90 + "b" * 60, "a b " * 30, "--- \n```\nx. y",
    "a" * 13, "1" + "a" * 14 + "1", "x" * 32 + "é" + "y" * 13, "a" * 31 + " " + "b" * 18, None,
]


def extract(text):
    """default_summarize() in plain Python."""
    flat = re.sub(r"[ \t\r\n]+", " ", text).strip(" ")
    title = re.sub("[^A-Za-z0-9 .,]", "", flat[:40]).strip(" ")
    terms = sorted(set(re.findall("[A-Za-z]{14,17}", text)))
    ids = "".join(f"\n  - term:{w}" for w in terms) or " []"
    return f"---\ntitle: {title}\nidentifiers:{ids}\n---\n\n" + ". ".join(flat.split(". ")[:2])


def test_extract_reads_a_text_once(spark, capsys):
    """The extract of odd texts is that of plain Python, and long words are looked for once."""
    rows = spark.createDataFrame(list(enumerate(ODD)), "n int, data string")
    got = {r.n: r.reply for r in rows.select("n", default_summarize(F.col("data")).alias("reply")).collect()}
    assert got == {n: x if x is None else extract(x) for n, x in enumerate(ODD)}
    rows.select(default_summarize(F.col("data")).alias("reply")).explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1


def test_bodies_are_not_shuffled_to_be_stored(spark, monkeypatch):
    """New rows are found without a shuffle of bodies, whatever Spark thinks of sizes; by a filter they are the same."""
    rows = spark.createDataFrame([(i, f"body {i}") for i in range(300)], "arrival long, data string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for step in (3, 300, 1, 1000):
            for first in ("new", "exists"):
                other = "exists" if first == "new" else "new"
                is_first = F.col("arrival") % step == (0 if step < 1000 else 999)
                results = rows.select("arrival", F.when(is_first, first).otherwise(other).alias("status"))
                want = sorted(r.arrival for r in results.where("status = 'new'").collect())
                counts = len(want), 300 - len(want)
                plain = ingest._new_rows(rows, results, *counts)
                assert sorted(r.arrival for r in plain.collect()) == want
                assert "hashpartitioning" not in plain._jdf.queryExecution().executedPlan().toString()
                monkeypatch.setattr(ingest, "SENT_ARRIVALS", 0)
                by_filter = ingest._new_rows(rows, results, *counts)
                assert sorted(map(tuple, by_filter.collect())) == [(i, f"body {i}") for i in want]
                monkeypatch.undo()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
