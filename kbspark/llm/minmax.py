"""MinHash near-dedup by min-max hashing: both ends of every permutation are kept, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.jaccard import roots, sieve, slices
from kbspark.llm.shingles import bands, mix, shingle_hashes, word_hashes
from kbspark.operators.components import components
from kbspark.session import materialise

WIDTH = 3
PERMUTATIONS, ROWS = 78, 6
BANDS = 2 * PERMUTATIONS // ROWS
# A hub and so many of its sets are one task's work, and so are two blocks of a bucket.
HUB_SETS, BLOCK_SETS, BLOCK_SHINGLES = 2048, 256, 1 << 15


class MinMax:
    """The least and the greatest value of sets under each of k permutations of 64-bit hashes.

    For either end, two sets agree with probability equal to their Jaccard similarity, so one
    evaluation of a permutation gives two values of a signature; as the ends of one permutation
    go against each other, an estimate from both has the lower variance of the two ways to
    get as many values. The signature holds all least values first: every band is of one end
    and of different permutations, whose values are independent.
    """

    def __init__(self, k: int, chunk: int = 1 << 17) -> None:
        rng = np.random.default_rng(12)
        self.k, self.chunk = k, chunk
        self.add = rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)
        self.times = rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def __call__(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of 2k values of sets given as flat hashes with their numbers; zeros for an empty set."""
        out = np.zeros((2 * self.k, len(counts)), np.uint64)
        sets = np.flatnonzero(counts)
        starts = np.r_[0, np.cumsum(counts[sets])]
        at = 0
        while at < len(sets):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + self.chunk, "right")) - 1)
            x, cuts = flat[starts[at] : starts[to]], starts[at:to] - starts[at]
            value = np.empty_like(x)
            for k in range(self.k):
                np.bitwise_xor(x, self.add[k], out=value)
                np.multiply(value, self.times[k], out=value)
                out[k, sets[at:to]] = np.minimum.reduceat(value, cuts)
                out[self.k + k, sets[at:to]] = np.maximum.reduceat(value, cuts)
            at = to
        return out.T


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of every text, in order of their hashes."""
    flat, counts = shingle_hashes(*word_hashes(texts), WIDTH)
    return [np.unique(s) for s in np.split(flat, np.cumsum(counts)[:-1])] if texts else []


def _set_names(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits of every set, whatever order its text has it in: rows of two uint64."""
    first = np.r_[0, np.cumsum(counts)]
    out = []
    for salt in (0x94D049BB133111EB, 0xD6E8FEB86659FD93):
        total = np.r_[np.uint64(0), np.cumsum(mix(flat ^ np.uint64(salt)))]
        out.append(mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64)))
    return np.stack(out, 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minmax = MinMax(PERMUTATIONS)
    for batch in batches:
        texts = batch.column("body").to_pylist()
        for start, end in slices(texts):
            sets = shingle_sets(texts[start:end])
            flat, counts = np.concatenate(sets), np.array([len(s) for s in sets])
            names = _set_names(flat, counts)
            keys = bands(minmax(flat, counts), ROWS)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            nodes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())
            given = batch.select(["id", "text_hash"]).slice(start, end - start)
            yield pa.RecordBatch.from_arrays([*given.columns, nodes, pa.array(counts, pa.int64()), keys], ["id", "text_hash", "node", "shingles", "keys"])


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common elements of the pairs of sets, counted exactly."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    # Many pairs: a product of 0/1 matrices over the shingles that two sets share, some columns at a time.
    sizes = np.array([len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, place = np.repeat(np.arange(len(sets)), sizes), np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[column]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (8 << 20) // len(sets))
    for at in range(0, int((seen > 1).sum()), width):
        use = (place >= at) & (place < at + width)
        held = np.zeros((len(sets), width), np.float32)
        held[row[use], place[use] - at] = 1
        common += held @ held.T
    return common[left, right].astype(np.int64)


def _alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    out = 100 * low >= percent * high
    a, b = left[out], right[out]
    common = _common(sets, a, b)
    out[out] = 100 * common >= percent * (sizes[a] + sizes[b] - common)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows without it) of rows that come in order of the columns `by`; groups are small by construction."""
    key, rows = None, []
    for batch in batches:
        names = [*by, *(n for n in batch.schema.names if n not in by)]
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if row[: len(by)] != key:
                if rows:
                    yield key, rows
                key, rows = row[: len(by)], []
            rows.append(row[len(by) :])
    if rows:
        yield key, rows


PAIR = "a binary, b binary"


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _to_hubs(percent: int):
    """Links of the sets of a group to its hub; the hub is the group's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set, place = None, None, None
        for batch in batches:
            found, texts = [], batch.column("body").to_pylist()
            places = list(zip(batch.column("hub").to_pylist(), batch.column("block").to_pylist()))
            nodes, is_member = batch.column("node").to_pylist(), batch.column("member").to_pylist()
            for start, end in slices(texts):
                sets = shingle_sets(texts[start:end])
                for i, mine in zip(range(start, end), sets):
                    if places[i] != place:
                        place, hub, hub_set = places[i], None, None
                    if not is_member[i]:
                        hub, hub_set = nodes[i], mine
                    elif hub is not None and _alike([hub_set, mine], np.array([0]), np.array([1]), percent)[0]:
                        found.append((nodes[i], hub))
            if found:
                yield _pairs(found)

    return run


def _across(percent: int):
    """Links between sets of different components in two blocks of a bucket, as links to a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _grouped(batches, ("key", "i", "j")):
            block, node, component, bodies = zip(*rows)
            sets, own, component = shingle_sets(list(bodies)), np.array(block), np.unique(component, return_inverse=True)[1]
            left, right = np.triu_indices(len(sets), 1)
            wanted = (component[left] != component[right]) & ((own[left] != own[right]) | (i == j))
            left, right = left[wanted], right[wanted]
            ok = _alike(sets, left, right, percent)
            linked = np.zeros((len(sets), len(sets)), bool)
            linked[left[ok], right[ok]] = linked[right[ok], left[ok]] = True
            found = [(node[x], node[r]) for x, r in enumerate(roots(linked)) if x != r]
            if found:
                yield _pairs(found)

    return run


def _with_text(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """asked (with a column node) and a text of each of its nodes.

    Asked nodes are few beside all texts; a sieve of fixed size keeps the others' texts out of the shuffle.
    """
    rows = materialise(asked.join(nodes.select("node", "text_hash"), "node"))
    short = F.xxhash64("text_hash")
    wanted = sieve(texts.select("text_hash", "body", short.alias("short")), "short", rows.select(short)).select("text_hash", "body")
    # Copies of a text are one row before they travel; the join is exact.
    return rows.join(wanted.dropDuplicates(["text_hash"]), "text_hash").drop("text_hash")


def _star_links(nodes: DataFrame, stars: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of nodes to the least node of their buckets: linear in the size of a bucket."""
    sized = stars.join(nodes.select("node", "shingles"), "node").join(nodes.select(F.col("node").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    low, high = F.least("shingles", "of_hub"), F.greatest("shingles", "of_hub")
    pairs = materialise(sized.where(100 * low >= percent * high).select("node", "hub"))
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SETS).cast("int").alias("blocks"))
    members = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", F.lit(True).alias("member"))
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"), F.lit(False).alias("member"))
    rows = _with_text(members.unionByName(hubs), nodes, texts)
    dealt = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "member")
    return materialise(dealt.mapInArrow(_to_hubs(percent), PAIR))


def _mixed_links(nodes: DataFrame, held: DataFrame, first: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets whose members are still of several components.

    Members of the largest one meet the others only, block by block; buckets of the same members
    are compared once. held: (key, node) of all buckets, first: (node, component) so far.
    """
    at = held.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    h = F.xxhash64("node")
    sums = at.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    # A bucket of two is its hub and one other, who have met.
    mixed = sums.where("n > 2 and low <> high").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    at = materialise(at.join(mixed, "key", "left_semi"))
    at = at.join(nodes.select("node", "shingles"), "node")
    parts = at.groupBy("key", "component").agg(F.count("*").alias("sets"), F.sum("shingles").alias("shingles"))
    blocks = lambda sets, shingles: F.ceil(F.greatest(sets / BLOCK_SETS, shingles / BLOCK_SHINGLES)).cast("int")
    most = parts.groupBy("key").agg(F.max(F.struct("sets", "component", "shingles")).alias("most"), F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"))
    most = most.select(
        "key",
        F.col("most.component").alias("main"),
        blocks(F.col("most.sets"), F.col("most.shingles")).alias("main_blocks"),
        blocks(F.col("sets") - F.col("most.sets"), F.col("shingles") - F.col("most.shingles")).alias("other_blocks"),
    )
    h = F.xxhash64("node")
    mine = F.col("component") == F.col("main")
    dealt = at.join(most, "key").withColumn("block", F.when(mine, F.pmod(h, F.col("main_blocks"))).otherwise(F.col("main_blocks") + F.pmod(h, F.col("other_blocks"))).cast("int"))
    met = F.sequence(F.when(mine, F.col("main_blocks")).otherwise(F.lit(0)), F.col("main_blocks") + F.col("other_blocks") - 1)
    dealt = dealt.withColumn("other", F.explode(met))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    rows = _with_text(dealt, nodes, texts)
    by = ["key", "i", "j"]
    return materialise(rows.repartition(*by).sortWithinPartitions(*by).select(*by, "block", "node", "component", "body").mapInArrow(_across(percent), PAIR))


def minmax_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A text's words are runs of non-blanks, A-Z lower-cased; its set are its distinct shingles of
    three words, or the whole sequence as one where it has fewer. Rows are linked when 100 times
    the intersection is at least `percent` times the union of their sets; component_id is the
    least id reached over links, a row's own included, and kept says that it is the row's own. A text without words (or null) is linked with
    nothing and kept. A row without id has the least id of its component, and is kept where the
    component has none. Rows that repeat an id count alike, so each may be kept. Ties, very long
    texts and groups of any size need no special care; an empty table gives no rows; other
    columns are not read.

    Candidates: 78 permutations give 156 values (both ends of each) in 26 bands of 6; a pair at
    0.85 is missed with probability 4.5e-6. Rows of equal sets are one node. In each bucket the
    nodes first meet its least one, which is linear; only buckets whose nodes are then still of
    several components are compared further, and there only across components, in pairs of
    hashed blocks of about BLOCK_SETS sets. Sets are compared in full.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("text_hash"), body.alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = materialise(texts.mapInArrow(_sketch, f"id {kind}, text_hash binary, node binary, shingles long, keys array<long>"))
    some = sketch.where("shingles > 0")
    nodes = materialise(some.groupBy("node").agg(F.min(F.struct("text_hash", "shingles", "keys")).alias("s")).select("node", "s.*"))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    hubs = materialise(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    held = materialise(sieve(keys, "key", hubs.select("key")).join(hubs, "key"))
    stars = held.where("node <> hub").select("node", "hub").distinct()
    links = _star_links(nodes, stars, texts, percent)
    first = materialise(components(links))
    more = _mixed_links(nodes, held.where("n > 2").select("key", "node"), first, texts, percent)
    if not more.isEmpty():
        first = components(links.unionByName(more))
    ids = some.groupBy("node").agg(F.min("id").alias("least")).join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    found = ids.join(least, "component").select("node", "component_id")
    out = some.select("id", "shingles", "node").join(found, "node").select("id", "shingles", "component_id")
    out = out.unionByName(sketch.where("shingles = 0").select("id", "shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("shingles").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
