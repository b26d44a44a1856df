"""Mixing sources to target weights by repetition rates and one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import materialise

# So many series of draws are tried for each source, and the one that comes nearest its target is used.
SERIES = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab and the line breaks up to CR; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(seed: str, series: Column, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the series and the parts alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), series.cast("string"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Targets of sources (source, source_size), filled by weight up to `most` times their size.

    Sources by code point, null last, take the weights in turn. A source that would pass its
    limit stops there and the rest is shared again by weight. Filling is the same as raising
    one level until the sum is reached, so the stopped sources are a prefix by limit / weight.
    The windows see one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_limit = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    at = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (at + 1).cast("int")).cast("double")
    s = sources.select("source", "source_size").withColumn("w", w)
    s = s.withColumn("ratio", F.col("source_size") * F.lit(float(most)) / F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("weight", F.sum("w").over(whole))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most))) / (F.col("weight") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.when(F.col("ratio") > F.col("level"), F.col("level")))
    s = s.withColumn("level", F.max("open").over(whole))  # later rows would stop a source that stays below its limit
    # Without an open source every limit is reached exactly.
    limit = F.col("source_size") * F.lit(float(most))
    return s.select("source", "source_size", F.coalesce(F.least(limit, F.col("level") * F.col("w")), limit).alias("target"))


def copies_of(seed: str, series: Column, key: Column, rate: Column) -> Column:
    """floor(rate) copies, and one more when the key's draw is below the rest of the rate."""
    return (F.floor(rate) + (unit_draw(seed, series, key) < rate - F.floor(rate)).cast("long")).cast("long")


def source_rates(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(s, source_size, target, rate, series) for each source, null being one; rate = target / source_size, 0 for size 0.

    series is the one of SERIES whose draws take the number of words nearest the target, the
    first of equals: what each would take is added up for all in one pass, before the shuffle.
    A document's chance in a series is the fraction of the rate, whichever series that is.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    found = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    found = materialise(found.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate")))
    met = sizes.join(found, F.col("source").eqNullSafe(F.col("s")))
    taken = [F.sum(copies_of(seed, F.lit(k), F.col("id"), F.col("rate")) * F.col("size")) for k in range(1, SERIES + 1)]
    apart = met.groupBy("s", "source_size", "target", "rate").agg(F.array(*[F.struct(F.abs(x - F.col("target")).alias("off"), F.lit(k).alias("k")) for k, x in enumerate(taken, 1)]).alias("tried"))
    return materialise(apart.select("s", "source_size", "target", "rate", F.array_min("tried")["k"].alias("series")))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: float = 3,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, rate, copies, taken.

    A document is taken floor(rate) times and once more when its draw is below the rest of
    the rate; rate = target / source_size. The draw hashes seed, the source's series (see
    source_rates) and id, so reruns agree and rows that repeat an id share it. Null source is a source of its own; null or blank text
    has size 0, and a source of size 0 has rate and target 0. Very long texts count like others.
    No rows give no rows; other columns are not read.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    out = sizes.join(source_rates(docs, weights, most, seed, id_col, text_col, source_col), F.col("source").eqNullSafe(F.col("s")))
    out = out.withColumn("copies", copies_of(seed, F.col("series"), F.col("id"), F.col("rate")))
    return out.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def emit_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: float = 3,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed documents themselves: every row of docs as often as mix_sources() takes it."""
    rates = source_rates(docs, weights, most, seed, id_col, text_col, source_col).select(F.struct("s", "rate", "series").alias("mixed"))
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"))
    out = rows.join(rates, F.col("source").eqNullSafe(F.col("mixed.s"))).withColumn("copies", copies_of(seed, F.col("mixed.series"), F.col("id"), F.col("mixed.rate")))
    out = out.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
