"""The pipeline's stages, one by one, and run() against a brute-force version of the decisions."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import quality
from kbspark.session import table
from test_dedup_ops import brute_jaccard
from test_mixing import fill


def write(spark, path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    good = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90)))
    bad = lambda: " ".join(rng.choice(vocabulary).upper() + rng.choice(["!!", "###", "$$$"]) for _ in range(rng.randint(20, 90)))
    rows = [(i, good() if i % 4 else bad()) for i in range(500)]
    for i in range(500, 540):  # exact copies, then near copies of one text
        rows.append((i, rows[i - 499][1]))
    base = good().split() + good().split()
    for i in range(540, 570):
        mine = list(base)
        mine[rng.randrange(len(mine))] = "changed"
        rows.append((i, " ".join(mine)))
    rows += [(570, None), (571, "")]
    docs = spark.createDataFrame([(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_run_against_brute_force(spark, tmp_path):
    write(spark, tmp_path)
    sf = str(tmp_path)
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    kept, out = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns
        kept.append(out.collect())
    model = quality.fit(docs, table(spark, sf, "labels").where(quality.remainder(F.col("doc_id"), 4) != 2))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert {r.doc_id for r in kept[0]} == {i for i, s in scores.items() if s >= 0.7}
    assert len({r.doc_id for r in kept[0]} & {i for i in range(500) if i % 4}) > 300
    last = {}
    for r in sorted(kept[0], key=lambda r: r.doc_id):
        last[r.text or ""] = r.doc_id
    assert sorted(r.doc_id for r in kept[1]) == sorted(last.values())
    classes = {c for _, c, *_ in brute_jaccard([(r.doc_id, r.text) for r in kept[1]])}
    assert sorted(r.doc_id for r in kept[2]) == sorted(classes)
    size = Counter()
    for r in kept[2]:
        size[r.source] += len((r.text or "").split())
    want, got = fill(dict(size)), Counter()
    for r in kept[3]:
        got[r.source] += len((r.text or "").split())
    for s in size:
        assert abs(got[s] - want[s]) < 0.25 * want[s] + 200
    times = Counter(r.doc_id for r in kept[3])
    assert max(times.values()) <= 3 and set(times) <= classes
    packed = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 1024 for b in bins.values())
    assert len(bins) <= 1.05 * math.ceil(sum(r.length for r in packed) / 1024) + 1
