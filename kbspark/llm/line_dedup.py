"""Line dedup: a sharded minimal perfect hash indexes counts that documents probe."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.session import materialise

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NULL_ID = -(1 << 63)
SECOND = "\x01"
GAMMA = 2.0


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return _mix(h1 ^ _mix(h2 + seed)) % np.uint64(bits)


def build_hash(h1: np.ndarray, h2: np.ndarray, most_levels: int = 48) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Levels (bits, words, rank before each word) of a minimal perfect hash over distinct key pairs.

    A key takes its bit on the first level where no other key left wants it; about three bits
    a key in all. With GAMMA 2 a level leaves 0.39 of the keys, so 48 levels end in practice
    for any shard; keys left over would be an error, never a wrong answer.
    """
    levels, before = [], 0
    while len(h1):
        if len(levels) == most_levels:
            raise ValueError("key pairs repeat")
        bits = max(64, -(-int(GAMMA * len(h1)) // 64) * 64)
        at = _place(h1, h2, len(levels), bits)
        wanted = np.bincount(at.astype(np.int64), minlength=bits)
        words = np.packbits(wanted == 1, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words)
        levels.append((bits, words, (before + np.cumsum(ones) - ones).astype(np.uint32)))
        before += int(ones.sum())
        left = wanted[at.astype(np.int64)] > 1
        h1, h2 = h1[left], h2[left]
    return levels


def lookup(levels: list[tuple[int, np.ndarray, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The index of each key pair; -1 for one that no level holds (which is then no key)."""
    found = np.full(len(h1), -1, np.int64)
    rest = np.arange(len(h1))
    for level, (bits, words, rank) in enumerate(levels):
        at = _place(h1[rest], h2[rest], level, bits)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
        found[rest[hit]] = rank[word[hit]].astype(np.int64) + below
        rest = rest[~hit]
    return found


def _index(shard: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one shard: hash levels, 16-bit fingerprints, counts up to 255, staying ids."""
    h1, h2 = (shard[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    levels = build_hash(h1, h2)
    at = lookup(levels, h1, h2)
    fingerprint, count, stay = np.empty(len(at), np.uint16), np.empty(len(at), np.uint8), np.empty(len(at), np.int64)
    n = shard["n"].to_numpy(np.int64)
    fingerprint[at], count[at], stay[at] = (h2 >> np.uint64(48)).astype(np.uint16), np.minimum(n, 255), shard["stay"].to_numpy(np.int64)
    out = io.BytesIO()
    parts = {f"{k}{i}": v for i, x in enumerate(levels) for k, v in zip(("bits", "words", "rank"), x)}
    np.savez(out, levels=len(levels), fingerprint=fingerprint, count=count, stay=stay, **parts)
    return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])], "probes": [int(shard["held"].sum())], "arrays": [out.getvalue()]})


def _probe(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by (shard, salt, kind): a shard's arrays, then what probes them."""
        arrays, levels = None, None
        for batch in batches:
            shard, salt, kind, h1, h2, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "kind", "h1", "h2", "key"))
            h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
            new = np.flatnonzero(kind == 0)
            drop = []
            for start, end in zip([-1, *new], [*new, len(kind)]):
                if start >= 0:
                    with np.load(io.BytesIO(batch.column("arrays")[int(start)].as_py())) as f:
                        arrays = {k: f[k] for k in f.files}
                    levels = [(int(arrays[f"bits{i}"]), arrays[f"words{i}"], arrays[f"rank{i}"]) for i in range(int(arrays["levels"]))]
                rows = np.arange(start + 1, end)
                if len(rows):
                    at = lookup(levels, h1[rows], h2[rows])
                    if (at < 0).any() or (arrays["fingerprint"][at] != (h2[rows] >> np.uint64(48)).astype(np.uint16)).any():
                        raise ValueError("a line is missing from the index of its shard")
                    drop.append(rows[(arrays["count"][at] >= least) & (arrays["stay"][at] != key[rows])])
            rows = np.concatenate(drop) if drop else np.empty(0, np.int64)
            names = ["key", "t", "h1", "h2"]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in names], names)

    return run


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _key_hash(key: Column) -> Column:
    """128 bits as two longs; the second hash sees a byte before the key, so the halves are independent."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(F.lit(SECOND), key)).alias("h2"))


def _cut(min_length: int):
    """Bodies without the lines whose key hashes are in `gone`; a set look-up a line, and only where something goes."""
    import xxhash

    low = str.maketrans(UPPER, LOWER)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines_of, dropped = [], [], []
            for body, gone in zip(batch.column("body"), batch.column("gone")):
                text = body.as_py()
                n, cut = text.count("\n") + 1, 0
                if gone.is_valid:
                    pairs = gone.values
                    drop = set(zip(pairs.field("h1").to_pylist(), pairs.field("h2").to_pylist()))
                    stay = []
                    for line in text.split("\n"):
                        bare = line.strip(BLANKS)
                        if len(bare) >= min_length:
                            raw = bare.translate(low).encode()
                            if (signed(xxhash.xxh64_intdigest(raw, 42)), signed(xxhash.xxh64_intdigest(SECOND.encode() + raw, 42))) in drop:
                                continue
                        stay.append(line)
                    text, cut = "\n".join(stay), n - len(stay)
                kept.append(text)
                lines_of.append(n)
                dropped.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 20,
    min_docs: int = 3,
    keys_per_shard: int = 1 << 18,
    probes_per_task: int = 1 << 21,
) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_text.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least
    min_length code points that at least min_docs (<= 255) different ids hold lose all their
    lines but those of the largest such id. Null or empty text is one empty line. Rows that
    repeat an id are one document for the counts and each loses its lines, known by its id and
    text; a null id counts as one id below all others. Ids that are no integers are compared as they are and known by
    a hash elsewhere. Lines are the same when 128 bits of their keys are. No rows give no rows;
    other columns are not read. A text of any length is cut in one pass over its lines.

    Distinct key hashes go to shards of about keys_per_shard; each shard's task builds the
    arrays. Holdings (key, id) are dealt to (shard, salt), a shard with more than
    probes_per_task of them being repeated for several salts, and stream past the arrays.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    key = F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(NULL_ID)).alias("key")
    body = F.coalesce(F.col(text_col), F.lit(""))
    # What a row loses is known by its id and text, so that rows of one id, or of none, share no set.
    rows = docs.select(F.col(id_col).alias("id"), key, F.xxhash64(body).alias("t"), body.alias("body"))

    def long_enough(line: Column) -> Column:
        return F.char_length(F.btrim(line, F.lit(BLANKS))) >= min_length

    # Distinct as texts, which Spark finds by hashing; structs it would compare pair by pair.
    keys = F.array_distinct(F.transform(F.filter(F.split("body", "\n"), long_enough), line_key))
    held = rows.select("key", "t", *([] if whole else ["id"]), F.explode(F.transform(keys, _key_hash)).alias("h"))
    held = materialise(held.select("h.h1", "h.h2", *([] if whole else ["id"]), "key", "t"))
    stay = F.max("key") if whole else F.coalesce(F.when(F.max("id").isNotNull(), F.xxhash64(F.max("id"))), F.lit(NULL_ID))
    counts = materialise(held.groupBy("h1", "h2").agg(F.count_distinct("key").alias("n"), F.count("*").alias("held"), stay.alias("stay")))
    shards = max(1, -(-counts.count() // keys_per_shard))
    shard = F.pmod(F.xxhash64(F.lit(11), "h1", "h2"), F.lit(shards)).cast("int").alias("shard")
    index = materialise(counts.select(shard, "h1", "h2", "n", "held", "stay").groupBy("shard").applyInPandas(_index, "shard int, probes long, arrays binary"))
    salts = index.select("shard", F.ceil(F.col("probes") / probes_per_task).cast("int").alias("salts"))
    none = F.lit(None).cast("binary")
    probes = held.select(shard, "h1", "h2", "key", "t").join(salts, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("key", "t"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "key", "t", none.alias("arrays"))
    zero = F.lit(0).cast("long")
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.ceil(F.col("probes") / probes_per_task).cast("int") - 1)).alias("salt"), F.lit(0).alias("kind"), zero.alias("h1"), zero.alias("h2"), zero.alias("key"), zero.alias("t"), "arrays")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.unionByName(probes).repartition(max(parts, shards), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    drop = dealt.mapInArrow(_probe(min_docs), "key long, t long, h1 long, h2 long")
    drop = drop.groupBy("key", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))

    out = rows.join(drop, ["key", "t"], "left").select("id", "body", "gone")
    return out.mapInArrow(_cut(min_length), f"id {kind.simpleString()}, n_lines long, n_dropped long, kept_text string").withColumnRenamed("id", id_col)
