"""What was seen before: a Bloom filter of fixed size in front of exact joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 ** BITS places, 64 to a word: as sent at most 2 ** (BITS - 6) words, 8 MB.
BITS = 25


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def words(keys: DataFrame) -> DataFrame:
    """(word, bits) of the keys (one column): the filter's words that are not zero."""
    places = keys.select(_place(F.col(keys.columns[0])).alias("p"))
    return places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))


def flagged(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """rows with `maybe`: false only where the key is in none of the filters whose words `held` has.

    Words of several filters are merged first, so what is broadcast has a fixed bound.
    """
    merged = held.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = rows.withColumn("p", _place(F.col(key))).withColumn("word", F.shiftright("p", 6)).join(F.broadcast(merged), "word", "left")
    hit = F.expr("shiftright(bits, cast(p % 64 as int)) & 1 = 1")
    return out.withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*rows.columns, "maybe")
