"""Sources: content-addressed storage, provenance, jobs, routing, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import clean_url, is_url, media_type

TEXT_CAP = 1_000_000
ATTACHMENT_CAP = 10 * 1024 * 1024
VISUAL = ["image/png", "image/jpeg", "image/gif", "image/webp"]


def store_sources(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Every row of batch (data, url, fetched, content_type, job, arrival) with digest and status.

    Empty data fails. The first arrival of a digest not yet stored is `new` and its provenance
    is the one to append; every other row `exists`. Type and url never change identity; arrival
    is unique. First arrivals come from light, pre-aggregated rows, and a digest that many rows
    share is one row on that side of the join, so that its copies can be split.
    """
    rows = batch.withColumn("digest", F.sha2(F.col("data").cast("binary"), 256)).withColumn("empty", F.coalesce(F.octet_length("data"), F.lit(0)) == 0)
    first = rows.where("not empty").groupBy(F.col("digest").alias("key")).agg(F.min("arrival").alias("first"))
    # Empty rows fail wherever they are; by arrival they are dealt out.
    key = F.when(F.col("empty"), F.col("arrival").cast("string")).otherwise(F.col("digest"))
    rows = rows.join(first, key == F.col("key"), "left").drop("key")
    known = F.lit(False)
    if stored is not None:
        rows = rows.join(stored.select(F.col("digest").alias("had")).distinct(), F.col("digest") == F.col("had"), "left")
        known = F.col("had").isNotNull()
    status = F.when(F.col("empty"), "failed").when(known | (F.col("arrival") > F.col("first")), "exists").otherwise("new")
    return rows.withColumn("status", status).drop("first", "empty", "had")


def plan_jobs(jobs: DataFrame, feed_items: DataFrame, seen: DataFrame) -> DataFrame:
    """(job, url, clean_url) to fetch, and a row with `fault` for each job that is not valid.

    A job has exactly one of feed and urls; mode is partial (the default: skip cleaned urls
    already stored) or full.
    """
    fault = (
        F.when(F.col("feed").isNotNull() & F.col("urls").isNotNull(), F.lit("both feed and urls"))
        .when(F.col("feed").isNull() & F.col("urls").isNull(), F.lit("neither feed nor urls"))
        .when(~F.coalesce("mode", F.lit("partial")).isin("partial", "full"), F.lit("unknown mode"))
    )
    jobs = jobs.withColumn("fault", fault)
    good = jobs.where("fault is null")
    by_feed = good.where("feed is not null").join(feed_items.select(F.col("feed_id").alias("feed"), F.col("url")), "feed").select("job", "mode", "url")
    by_list = good.where("urls is not null").select("job", "mode", F.explode("urls").alias("url"))
    wanted = by_feed.unionByName(by_list).withColumn("clean_url", clean_url(F.col("url")))
    partial = wanted.where(F.coalesce("mode", F.lit("partial")) == "partial").join(seen.select(clean_url(F.col("url")).alias("clean_url")).distinct(), "clean_url", "left_anti")
    fetch = wanted.where("mode = 'full'").unionByName(partial).select("job", "url", "clean_url", F.lit(None).cast("string").alias("fault"))
    return fetch.unionByName(jobs.where("fault is not null").select("job", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("clean_url"), "fault"))


def route(data: Column, content_type: Column, url: Column, pdf: bool = False, attachment_cap: int = ATTACHMENT_CAP) -> Column:
    """What summarising does with a source: text or attachment, else why it can not."""
    size, kind = F.octet_length(data), media_type(content_type, url)
    return (
        F.when(data.isNull(), F.lit("actionable: missing"))
        .when(kind.isin(VISUAL) & (size > attachment_cap), F.lit("actionable: too large"))
        .when(kind.isin(VISUAL), F.lit("attachment"))
        .when((kind == "application/pdf") & F.lit(not pdf), F.lit("actionable: pdf disabled"))
        .when((kind == "application/pdf") & (size > attachment_cap), F.lit("actionable: too large"))
        .when(kind == "application/pdf", F.lit("attachment"))
        .when(~F.is_valid_utf8(data), F.lit("inert: not text"))
        .when(size > TEXT_CAP, F.lit("actionable: too large"))
        .otherwise(F.lit("text"))
    )


def tally(stored: DataFrame) -> DataFrame:
    """new, exists and failed rows of each job."""
    return stored.groupBy("job").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "exists", "failed")])


def stored_urls(sources: DataFrame) -> DataFrame:
    return sources.select("url").where(is_url(F.col("url"))).distinct()


def log_entries(kind: str, title: Column, ts: Column) -> Column:
    return F.concat(F.lit(f"## [{kind}] "), title, F.lit(" - "), ts)
