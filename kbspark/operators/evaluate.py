"""Retrieval evaluation: metrics over full rankings, profiles of similarities, label agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rankings(scores: DataFrame) -> DataFrame:
    """scores (query, slug, pos, score) ranked within each query; equal scores keep the pages' order."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "pos")))


def retrieval_metrics(counts: DataFrame) -> DataFrame:
    """One row over the counts of each query (see vectors.relevant_counts); queries without a relevant page do not count.

    recall@5, recall@10 over all relevant pages, MRR of the first relevant page at any rank,
    hits of the top ten under the cutoff, mean rank of short and of long relevant pages.
    """
    return counts.agg(
        F.count("*").alias("queries"),
        F.avg(F.col("at5") / F.col("n")).alias("recall_at_5"),
        F.avg(F.col("at10") / F.col("n")).alias("recall_at_10"),
        F.avg(1 / F.col("first")).alias("mrr"),
        F.coalesce(F.sum("under"), F.lit(0)).alias("under_cutoff"),
        (F.sum("short_sum") / F.sum("short_n")).alias("mean_rank_short"),
        (F.sum("long_sum") / F.sum("long_n")).alias("mean_rank_long"),
    )


def model_table(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Models side by side, best recall@5 first: metrics (by model) and what a run of each took.

    runs (model, kind, dims, pages, cost_usd, wall_seconds). Bytes are four a dimension; cost
    and wall time are for a thousand pages, cost only where a model is hosted; a model without
    metrics was run on no query and has zeros.
    """
    out = runs.join(metrics, "model", "left")
    thousand = lambda c: F.round(F.col(c) / F.col("pages") * 1000, 4)
    hosted = F.col("kind") == "hosted"
    return out.select(
        "model",
        "kind",
        "dims",
        (F.col("dims") * 4).alias("bytes_per_page"),
        *[F.coalesce(F.round(c, 9), F.lit(0.0)).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")],
        F.coalesce("queries", F.lit(0)).alias("queries"),
        F.when(hosted, thousand("cost_usd")).alias("cost_per_1k"),
        thousand("wall_seconds").alias("wall_per_1k"),
        F.when(hosted, "wall time network-bound").otherwise("-").alias("notes"),
    ).orderBy(F.desc("recall_at_5"), "model")


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row (recall, queries) over the queries of relevant (query, n, above 0): what share of the n is among the first k."""
    hits = ranked.where((F.col("rank") <= k) & F.col("relevant")).groupBy("query").agg(F.count("*").alias("hits"))
    return relevant.join(hits, "query", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), F.count("*").alias("queries"))


def label_agreement(labels: DataFrame) -> DataFrame:
    """labels (q, hand, judge) with Jaccard (both empty: 1), what only one side has, and exact."""
    both = F.size(F.array_intersect("hand", "judge"))
    either = F.size(F.array_union("hand", "judge"))
    jaccard = F.when(either == 0, 1.0).otherwise(both / either)
    return labels.select(
        "q",
        F.round(jaccard, 4).alias("jaccard"),
        F.array_sort(F.array_except("hand", "judge")).alias("hand_only"),
        F.array_sort(F.array_except("judge", "hand")).alias("judge_only"),
        (jaccard == 1.0).alias("exact"),
    )


def parse_labels(reply, valid):
    """A model's reply, a JSON list perhaps in a fence, as labels; unknown ones dropped, repeats kept."""
    bare = F.regexp_replace(F.btrim(reply, F.lit(" \t\r\n")), r"^```[a-z]*\s*|\s*```$", "")
    return F.filter(F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>")), lambda x: F.array_contains(valid, x))
