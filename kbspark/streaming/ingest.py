"""Sources as a stream: each micro-batch is stored, summarised, embedded and placed under its batch id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import models
from kbspark.functions import text as t
from kbspark.operators import forms as fm
from kbspark.operators import pages as pg
from kbspark.operators import seen
from kbspark.operators import stories as st
from kbspark.operators import vectors as vec
from kbspark.session import materialise, scratch
from kbspark.sources.store import route

# What each batch writes, under batch=<id>. A story has a row for each batch that touched it.
SCHEMAS = {
    "results": "arrival long, digest string, url string, job string, status string, route string, reason string",
    "sources": "arrival long, digest string, data string, url string, fetched string, content_type string, job string",
    "seen": "word long, bits long",
    "pages": "name string, digest string, slug string, title string, identifiers array<string>, source_url string, fetched string, body string",
    "dropped": "digest string, reason string",
    "vectors": "name string, kind string, title string, embed_hash string, embedding array<float>",
    "placements": "digest string, story string, action string, seq int",
    "forms": "story string, key string, norm string",
    "stories": "story string, title string, members array<string>, first_seen string, last_seen string, identifiers array<string>",
}


@dataclass(frozen=True)
class Models:
    """What a batch asks: replies for texts, vectors for pages, and a judge, if there is one."""

    summarize: Callable[[Column], Column] = models.default_summarize
    embed: Callable[[pd.Series], pd.Series] = vec.default_embed
    judge: st.Judge | None = None


class Tables:
    """The tables below one path. A batch reads what batches before it wrote and overwrites its own folders only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def prepare(self) -> None:
        for name, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}/batch=-1")

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        path = f"{self.path}/{name}/batch={batch}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(columns).parquet(path)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        df = self.spark.read.schema(f"{SCHEMAS[name]}, batch int").parquet(f"{self.path}/{name}")
        return df if before is None else df.where(F.col("batch") < before)

    def stories(self, before: int | None = None) -> DataFrame:
        """Every story as the last batch that touched it left it."""
        df = self.read("stories", before)
        row = F.struct(*[c for c in df.columns if c != "batch"])
        return df.groupBy("story").agg(F.max_by(row, "batch").alias("row")).select("row.*")


# Numbers of arrivals, 8 bytes each, that are sent to where the bodies are.
SENT_ARRIVALS = 1 << 20


def _new_rows(rows: DataFrame, results: DataFrame, n_new: int, n_other: int) -> DataFrame:
    """The rows that are new by results, found by the new arrivals or the others, whichever are fewer.

    Up to SENT_ARRIVALS are sent to the rows. Of more, only rows that a filter of them does not
    rule out are joined; of all others the body is not shuffled.
    """
    if not n_new or not n_other:
        return rows if n_new else rows.limit(0)
    few = results.where("status = 'new'" if n_new <= n_other else "status <> 'new'").select("arrival")
    how = "left_semi" if n_new <= n_other else "left_anti"
    if min(n_new, n_other) <= SENT_ARRIVALS:
        return rows.join(F.broadcast(few), "arrival", how)
    marked = seen.flagged(rows, "arrival", materialise(seen.words(few)))
    joined = marked.where("maybe").drop("maybe").join(few, "arrival", how)
    return joined if how == "left_semi" else marked.where("not maybe").drop("maybe").unionByName(joined)


def _store(tables: Tables, rows: DataFrame, batch: int) -> DataFrame:
    """Outcomes first, from rows without bodies; then the bodies of new rows, and what is seen from now on."""
    rows = rows.withColumn("digest", F.sha2(F.col("data").cast("binary"), 256))
    light = rows.select("arrival", "digest", "url", "job", F.coalesce(F.octet_length("data"), F.lit(0)).alias("size"), route(F.col("data").cast("binary"), F.col("content_type"), F.col("url")).alias("route"))
    light = materialise(seen.flagged(light, "digest", tables.read("seen", batch)))
    # Digests that may be stored are few in most batches; only they are looked up, in the digests alone.
    asked = materialise(light.where("maybe and size > 0").select("digest").distinct())
    had = tables.read("results", batch).where("status = 'new'").join(asked, "digest", "left_semi").select(F.col("digest").alias("had")).distinct()
    first = light.where("size > 0").groupBy(F.col("digest").alias("of")).agg(F.min("arrival").alias("first"))
    # Empty rows, however many, share no key.
    of = F.when(F.col("size") > 0, F.col("digest"))
    out = light.join(first, of == F.col("of"), "left").join(had, of == F.col("had"), "left")
    status = F.when(F.col("size") == 0, "failed").when(F.col("had").isNotNull() | (F.col("arrival") > F.col("first")), "exists").otherwise("new")
    out = out.withColumn("status", status).withColumn("reason", F.when(F.col("size") == 0, "empty"))
    results = tables.write("results", batch, out)
    counts = {r.is_new: r.n for r in results.groupBy((F.col("status") == "new").alias("is_new")).agg(F.count("*").alias("n")).collect()}
    stored = tables.write("sources", batch, _new_rows(rows, results, counts.get(True, 0), counts.get(False, 0)))
    tables.write("seen", batch, seen.words(results.where("status = 'new'").select("digest")))
    return stored


def _summarise(tables: Tables, stored: DataFrame, batch: int, ask: Models) -> DataFrame:
    """A page for every text whose reply makes one; of the others the reason."""
    stored = stored.withColumn("route", route(F.col("data").cast("binary"), F.col("content_type"), F.col("url")))
    # A reply is a column of its own: what unwraps it names it many times, and each would ask again.
    # Where a text is from goes along, so that no page is joined with its source.
    replies = stored.where("route = 'text'").select(F.struct("digest", F.col("url").alias("source_url"), "fetched").alias("of"), ask.summarize(F.col("data")).alias("reply"))
    replies = replies.select("of", pg.unwrap_reply(F.col("reply")).alias("text"))
    parsed = materialise(pg.parse_pages(replies, "of").withColumn("reason", pg.drop_reason()).select("of.*", "reason", "fields", "body"))
    # Why others are none is known since they were stored; no body is read for it.
    lost = tables.read("results").where((F.col("batch") == batch) & (F.col("status") == "new") & (F.col("route") != "text")).select("digest", F.col("route").alias("reason"))
    tables.write("dropped", batch, lost.unionByName(parsed.where("reason is not null").select("digest", "reason")))
    good = parsed.where("reason is null").select("digest", "source_url", "fetched", F.trim(pg.scalar("title")).alias("title"), pg.listed("identifiers").alias("identifiers"), "body")
    good = good.withColumn("slug", t.slugify(F.col("title")))
    return tables.write("pages", batch, pg.page_names(good, tables.read("pages", batch), 12, ["fetched", "digest"]))


def _embed(tables: Tables, pages: DataFrame, batch: int, ask: Models) -> DataFrame:
    text = t.embed_text(F.lit(True), F.col("name"), F.col("title"), F.col("identifiers"), F.lit(""), F.col("body"))
    rows = pages.select("name", F.lit("summary").alias("kind"), "title", text.alias("text"))
    rows = rows.withColumn("embed_hash", t.embed_hash(F.col("kind"), F.col("title"), F.col("text")))
    return tables.write("vectors", batch, rows.withColumn("embedding", vec.embedded(F.col("text"), ask.embed)))


def _nearest(tables: Tables, pages: DataFrame, fresh: DataFrame, batch: int) -> DataFrame:
    """(digest, other, rank): the rows nearest each new page, stored ones by the story that holds them."""
    named = tables.read("pages", batch).select("name", "digest").join(tables.read("placements", batch).select("digest", "story"), "digest")
    named = named.select("name", F.concat(F.lit("story:"), "story").alias("other")).unionByName(pages.select("name", F.col("digest").alias("other")))
    every = tables.read("vectors", batch).select("name", "kind", "embedding").unionByName(fresh.select("name", "kind", "embedding"))
    near = vec.neighbours(every, fresh.select(F.col("name").alias("query"), "kind", "embedding"))
    near = near.join(pages.select(F.col("name").alias("query"), "digest"), "query").join(named, "name")
    return materialise(near.groupBy("digest", "other").agg(F.min("rank").alias("rank")))


def _place(tables: Tables, pages: DataFrame, fresh: DataFrame, batch: int, ask: Models) -> None:
    """New pages join stories or start them; stories that share nothing with them are not read into it."""
    near = _nearest(tables, pages, fresh, batch) if ask.judge else None
    new = fm.forms(pages, "digest")
    touched = tables.read("forms", batch).join(new.select("key", "norm").distinct(), ["key", "norm"], "left_semi").select("story")
    touched = touched.unionByName(pages.select(F.col("slug").alias("story")))
    if near is not None:
        touched = touched.unionByName(near.where(F.col("other").startswith("story:")).select(F.substring("other", 7, 1 << 20).alias("story")))
    before = materialise(tables.stories(batch).join(touched.distinct(), "story", "left_semi"))
    placed = tables.write("placements", batch, st.place(pages, before, ask.judge, near))
    order = Window.partitionBy("story").orderBy("fetched", "digest")
    own = placed.join(pages, "digest").withColumn("pos", F.row_number().over(order))
    own = materialise(own.select("story", "pos", "digest", "title", "fetched", "identifiers"))
    old = before.join(own.select("story").distinct(), "story", "left_semi")
    # The story as it was counts as a member before the new ones.
    both = own.unionByName(old.select("story", F.lit(0).alias("pos"), F.concat(F.lit("story:"), "story").alias("digest"), "title", F.lit("").alias("fetched"), "identifiers"))
    ids = st.union_identifiers(both.select("story", "pos", "digest"), both.select("digest", "identifiers"))
    grown = own.groupBy("story").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("added"), F.min_by("title", "pos").alias("new_title"), F.min("fetched").alias("least"), F.max("fetched").alias("most")
    )
    empty = F.array().cast("array<string>")
    rows = grown.join(old.withColumnRenamed("identifiers", "had"), "story", "left").join(ids, "story", "left")
    tables.write(
        "stories",
        batch,
        rows.select(
            "story",
            F.coalesce("title", "new_title").alias("title"),
            F.concat(F.coalesce("members", empty), "added").alias("members"),
            F.least(F.coalesce("first_seen", "least"), "least").alias("first_seen"),
            F.greatest(F.coalesce("last_seen", "most"), "most").alias("last_seen"),
            F.coalesce("identifiers", empty).alias("identifiers"),
        ),
    )
    tables.write("forms", batch, own.select("story", "digest").join(new, "digest").select("story", "key", "norm").distinct())


def ingest_batch(rows: DataFrame, batch: int, path: str, ask: Models | None = None) -> None:
    """One batch of (data, url, fetched, content_type, job, arrival) through all steps.

    Every step writes its table under the batch's number and reads earlier numbers only, so a
    batch that runs again, after a failure or by force, leaves the tables as they were. A row
    that fails any step is an outcome with a reason and stops nothing.
    """
    tables, ask = Tables(rows.sparkSession, path), ask or Models()
    stored = _store(tables, rows, batch)
    pages = _summarise(tables, stored, batch, ask)
    fresh = _embed(tables, pages, batch, ask)
    _place(tables, pages, fresh, batch, ask)


def ingest_stream(batches: DataFrame, path: str, checkpoint: str, ask: Models | None = None):
    """Start taking a stream of (data, url, fetched, content_type, job, arrival) in below `path`."""
    Tables(batches.sparkSession, path).prepare()
    step = lambda rows, batch: ingest_batch(rows, batch, path, ask)
    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_all(spark: SparkSession, batches: DataFrame, ask: Models | None = None) -> Tables:
    """Run the stream over what there is and return its tables."""
    path = scratch(spark)
    ingest_stream(batches, path, f"{path}/progress", ask).awaitTermination()
    return Tables(spark, path)
