"""The corpus pipeline: stages applied to documents, each written as Parquet and read again.

Every stage takes documents with any further columns and, but for the last, returns the same
columns. A null text counts as an empty one and stays null; empty and very long texts are
scored, compared, mixed and packed whole like others; an empty table gives an empty table.
What a stage does with ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import exact_dedup, jaccard, mixing, packing, quality
from kbspark.llm.queries import tokenizer
from kbspark.session import materialise, table

LEAST_QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under LEAST_QUALITY go; labels of held-out ids are not learned from.

    Equal texts have equal scores and go or stay together, whatever their ids.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(quality.remainder(F.col("doc_id"), 4) != 2))
    return quality.keep_good(docs, model, LEAST_QUALITY)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat it one, whichever; a null id yields to any other."""
    return exact_dedup.distinct_texts(docs, keep="largest")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more on five-word shingles the least doc_id stays; null ids yield to others.

    Rows that repeat both id and text stay or go together. Texts without words are copies of one another.
    """
    return jaccard.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate; a null source is one, the last. Draws go by id, so rows of one id are drawn alike."""
    return mixing.emit_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024; a document taken twice has each piece twice."""
    pieces = packing.token_pieces(docs, tokenizer("byte_bpe_50k.json"), ["doc_id", "source"])
    return packing.pack(pieces, ["doc_id", "source"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

# Compression, MinHash classes and token ids have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
