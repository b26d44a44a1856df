"""A stored vector table in buckets: a sweep writes only buckets that change, a manifest says which version holds each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import vectors as vec
from kbspark.session import materialise

ROW = "name string, kind string, title string, embed_hash string, embedding array<float>"


class VectorTable:
    """Rows of ROW below path, dealt to buckets by name.

    data/version=N/bucket=B has what version N wrote, manifest/version=N the version that holds
    each bucket now. A manifest is written last, in one commit: a sweep that dies before it
    leaves the version before in force, and one that runs again writes the same version anew.
    Readers of an older version are not disturbed; its files are not deleted here. The number
    of buckets is fixed when the table is made; the driver holds one small number for each.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, name: str | Column = "name") -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, int]]:
        """(latest version, version of each bucket that has rows)."""
        held = self.spark.read.schema("bucket int, at int, version int").parquet(f"{self.path}/manifest")
        rows = held.where(F.col("version") == held.agg(F.max("version")).first()[0]).collect()
        return rows[0].version, {r.bucket: r.at for r in rows if r.bucket >= 0}

    def _commit(self, version: int, held: dict[int, int]) -> None:
        # A row of no bucket, so that a table without rows has a version too.
        rows = [(-1, version), *sorted(held.items())]
        self.spark.createDataFrame(rows, "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _write(self, version: int, rows: DataFrame) -> set[int]:
        """Write rows as buckets of a version; the buckets that have any."""
        out = rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", "name")
        target = f"{self.path}/data/version={version}"
        out.write.mode("overwrite").partitionBy("bucket").parquet(target)
        found = self.spark.read.schema(f"{ROW}, bucket int").parquet(target).select("bucket").distinct()
        return {r.bucket for r in found.collect()}

    def create(self, rows: DataFrame) -> None:
        self._commit(1, dict.fromkeys(self._write(1, rows.select(*[c.split()[0] for c in ROW.split(", ")])), 1))

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows now, of all buckets or of some."""
        _, held = self.manifest()
        paths = [f"{self.path}/data/version={at}/bucket={b}" for b, at in sorted(held.items()) if only is None or b in only]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def sweep(self, pages: DataFrame, embed: Callable[[pd.Series], pd.Series] = vec.default_embed) -> set[int]:
        """Bring the table in step with pages (name, kind, title, embed_hash, text); the buckets that were written.

        Vanished pages' rows go, new and changed pages are embedded, all other vectors stay. What
        changed is told by names and hashes; vectors are read and written in touched buckets only.
        """
        version, held = self.manifest()
        plan = materialise(vec.embed_plan(pages, self.read()).where("state <> 'current'"))
        touched = {r.bucket for r in plan.select(self.bucket().alias("bucket")).distinct().collect()}
        if not touched:
            return touched
        stale = pages.join(plan.where("state = 'stale'").select("name"), "name", "left_semi")
        fresh = stale.withColumn("embedding", vec.embedded(F.col("text"), embed)).select("name", "kind", "title", "embed_hash", "embedding")
        kept = self.read(touched).join(plan.select("name"), "name", "left_anti")
        filled = self._write(version + 1, kept.unionByName(fresh))
        self._commit(version + 1, {b: at for b, at in held.items() if b not in touched} | dict.fromkeys(filled, version + 1))
        return touched
