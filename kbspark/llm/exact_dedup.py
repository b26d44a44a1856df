"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import materialise


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_fn: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows whose whole texts are the same bytes form a group and the row with the smallest
    (or, with keep="largest", the largest) id stays. A null text is empty text. A null id
    stays only where its whole group has null ids. Of repeated rows with the staying id
    exactly one is marked kept. An empty table gives no rows. Other columns of docs,
    whatever their names, are not read.

    The shuffle of (hash, text) is combined on the map side first, so a group of any size
    sends one row a task. Comparing the bytes is the grouping by the text beside its hash;
    where two texts share a hash, the rows of that hash alone are matched by their text.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("h", hash_fn(F.col("body")))
    texts = rows.groupBy("h", "body").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    hashes = materialise(
        texts.groupBy("h").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    )
    light = rows.select("id", "h", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    collided = hashes.where("texts > 1").select("h")
    found = light.join(hashes.where("texts = 1").select("h", "keep_id", "group_size"), "h")
    if not collided.isEmpty():
        exact = rows.join(collided, "h", "left_semi").join(texts.join(collided, "h", "left_semi"), ["h", "body"])
        found = found.unionByName(
            exact.select("h", "id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
        )
    again = F.row_number().over(Window.partitionBy("id", "text_sha256").orderBy(F.lit(0)))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"),
        "text_sha256",
    )


def distinct_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_fn: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns, in one shuffle.

    The group's key is the hash and the text itself, so the bytes are compared as above; of
    rows that repeat the staying id one stays, whichever.
    """
    pick = {"smallest": F.min_by, "largest": F.max_by}[keep]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], F.col(text_col).isNull().alias("none"))
    # Structs compare null ids as lowest; so that a known id is preferred, smallest puts them last.
    order = F.struct(F.col(id_col).isNull() if keep == "smallest" else F.lit(False), F.col(id_col))
    rows = docs.select(row.alias("row"), order.alias("order"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    stay = rows.withColumn("h", hash_fn(F.col("body"))).groupBy("h", "body").agg(pick("row", "order").alias("row"))
    text = F.when(~F.col("row.none"), F.col("body")).alias(text_col)
    return stay.select(*[text if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
