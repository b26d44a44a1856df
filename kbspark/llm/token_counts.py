"""Token counts through a digest cache: only texts the cache lacks are encoded, once each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.session import scratch

CACHE = T.StructType(
    [T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
)


@lru_cache(maxsize=4)
def _encoder(path: str):
    """texts -> numbers of tokens, once a Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def _encode(path: str, most_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            texts, counts, part, size = batch.column("body").to_pylist(), [], [], 0
            for text in texts:
                part.append(text)
                size += len(text)
                if size >= most_bytes:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The content digest is the SHA-256 of the text's bytes (null counts as empty), the other
    half of the key is tokenizer_version(). Texts are combined to one a digest before they
    are shuffled, those in the cache drop out, the rest are encoded whole and appended to
    the cache, a Parquet table at cache_path with a folder for each tokenizer version, so that
    only this version's counts are read; a second run finds all of them there. Without
    cache_path the cache is a new one in the session's shared folder. Rows that repeat are
    all returned; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = cache_path or scratch(spark)
    version = tokenizer_version(tokenizer_path)
    spark.createDataFrame([], CACHE).write.partitionBy("tokenizer").mode("append").parquet(path)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))

    def known() -> DataFrame:
        cache = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == version)
        return cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have added one digest

    missing = rows.select("digest", "body").dropDuplicates(["digest"]).join(known().select("digest"), "digest", "left_anti")
    counted = missing.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.partitionBy("tokenizer").mode("append").parquet(path)
    out = rows.select("id", "digest", F.octet_length("body").cast("long").alias("n_bytes")).join(known(), "digest")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
