"""N-gram Jaccard join: MinHash bands give groups, Bayesian pruning and exact checks give links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shingles import MinHash, bands, fingerprints, shingle_hashes, word_hashes
from kbspark.operators.components import components
from kbspark.session import materialise

BANDS, ROWS = 40, 6
STEP = 24
BLOCK_SHINGLES, BLOCK_SETS = 1 << 15, 256
DEALT_BY = ("component", "key", "i", "j")


def least_matches(threshold: float, tolerance: float, step: int, total: int) -> list[tuple[int, int]]:
    """(compared, matches needed): fewer matches make P(similarity >= threshold) < tolerance.

    With a uniform prior, m of n equal values give a Beta(m + 1, n - m + 1) posterior, and its
    mass above the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(step, total + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def slices(texts: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(BANDS * ROWS)
    for batch in batches:
        texts, done = batch.column("body").to_pylist(), 0
        for start, end in slices(texts):
            words, counts = word_hashes(texts[start:end])
            node = fingerprints(words, counts)
            flat, sizes = shingle_hashes(words, counts)
            keys = bands(minhash(flat, sizes), ROWS)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            nodes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(node), [None, pa.py_buffer(node.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(start, end - start), batch.column("text_hash").slice(start, end - start), nodes, pa.array(sizes, pa.int64()), keys],
                ["id", "text_hash", "node", "shingles", "keys"],
            )
            done = end
        assert done == len(texts)


def _links(sets: list[np.ndarray], own: np.ndarray, threshold: float, needed: list[tuple[int, int]], same: bool, key: int | None = None, keys: list | None = None) -> np.ndarray:
    """Matrix of links among the sets: all pairs of one block, or the pairs across two (own: which).

    In a bucket (key) only the pairs whose first common band it is, by the sets' keys: no pair counts twice.
    """
    minhash = MinHash(BANDS * ROWS)
    sizes = np.array([len(s) for s in sets])
    signature = minhash(np.concatenate(sets) if sets else np.empty(0, np.uint64), sizes)
    left, right = np.triu_indices(len(sets), 1)
    if not same:
        across = own[left] != own[right]
        left, right = left[across], right[across]
    if key is not None:
        held, mine = np.array(keys, np.int64), np.zeros(len(left), bool)
        for at in range(0, len(left), 1 << 14):
            some = slice(at, at + (1 << 14))
            first = (held[left[some]] == held[right[some]]).argmax(1)
            mine[some] = held[left[some], first] == key
        left, right = left[mine], right[mine]
    matches, before = np.zeros(len(left), np.int32), 0
    for n, least in needed:
        part = signature[:, before:n]
        for at in range(0, len(left), 1 << 14):
            matches[at : at + (1 << 14)] += (part[left[at : at + (1 << 14)]] == part[right[at : at + (1 << 14)]]).sum(1, dtype=np.int32)
        alive = matches >= least
        left, right, matches, before = left[alive], right[alive], matches[alive], n
    if len(left) > 4 * len(sets):
        # Many pairs are left: count common shingles by a product over the shingles that two sets share.
        values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(sets)), sizes), seen[column] > 1
        place = np.cumsum(seen > 1) - 1
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, (8 << 20) // len(sets))
        for at in range(0, int((seen > 1).sum()), width):
            c = place[column]
            use = shared & (c >= at) & (c < at + width)
            held = np.zeros((len(sets), width), np.float32)
            held[row[use], c[use] - at] = 1
            common += held @ held.T
        common = common[left, right].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    ok = common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9
    out = np.zeros((len(sets), len(sets)), bool)
    out[left[ok], right[ok]] = out[right[ok], left[ok]] = True
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each set the least place that links lead to."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(1, initial=len(linked)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance, STEP, BANDS * ROWS)

    def one(group: list[tuple]) -> list[tuple]:
        _, key, i, j, *_ = group[0]
        own, nodes, bodies, keys = zip(*(g[4:] for g in group))
        words, counts = word_hashes(bodies)
        flat, sizes = shingle_hashes(words, counts)
        cut = np.cumsum(sizes)[:-1]
        sets = [np.unique(s) for s in np.split(flat, cut)]
        linked = _links(sets, np.array(own), threshold, needed, i == j, key, keys)
        n, root = linked.sum(1), roots(linked)
        return [(a, int(k), nodes[r]) for a, k, r in zip(nodes, n, root) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by (component, key, i, j); each such block pair is small by construction."""

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            a, n, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(b, pa.binary())], ["a", "links", "b"])

        key, group = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*DEALT_BY, "block", "node", "body", "keys"))):
                if row[:4] != key:
                    found += one(group) if len(group) > 1 else []
                    key, group = row[:4], []
                group.append(row)
            if found:
                yield batch_of(found)
        if len(group) > 1 and (found := one(group)):
            yield batch_of(found)

    return run


SIEVE_BITS = 25


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose long `key` may be among `wanted` (one long column): one hash, 2 ** SIEVE_BITS bits.

    What is broadcast is at most 2 ** (SIEVE_BITS - 6) words, 8 MB, whatever the data. More
    wanted keys let more rows through to the exact join that follows, never fewer.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE_BITS))
    bits = wanted.select(place(F.col(wanted.columns[0])).alias("p"))
    bits = bits.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    out = rows.withColumn("p", place(F.col(key))).withColumn("word", F.shiftright("p", 6)).join(F.broadcast(bits), "word")
    return out.where(F.expr("shiftright(bits, cast(p % 64 as int)) & 1 = 1")).select(*rows.columns)


def _in_blocks(members: DataFrame, *by: str) -> DataFrame:
    """by, sets, blocks: the sets of each group, and the hashed blocks that keep them small."""
    sizes = members.groupBy(*by).agg(F.sum("shingles").alias("shingles"), F.count("*").alias("sets"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    return sizes.select(*by, "sets", blocks.alias("blocks"))


def _dealt(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """component, key, blocks, keys, node, text_hash: where each set is compared.

    A component of b blocks carries each of its texts b times. Texts alike in part, none of
    them copies, chain into components that grow with the corpus while their buckets stay
    small: where the sets times the blocks of a component's buckets come to less than those of
    the component itself, it is dealt by bucket (key), with the sets' keys. Both ways compare
    every pair that shares a bucket.
    """
    whole = materialise(_in_blocks(member, "component"))
    # A table of its own, so that Spark knows its size before it would shuffle all nodes' keys.
    many = materialise(member.join(whole.where("blocks > 1").select("component"), "component", "left_semi"))
    many = many.join(nodes.select("node", "keys"), "node")
    buckets = _in_blocks(many.select("component", "shingles", F.explode("keys").alias("key")), "component", "key").where("sets > 1")
    buckets = materialise(buckets)
    cost = buckets.groupBy("component").agg(F.sum(F.col("sets") * F.col("blocks")).alias("cost"))
    apart = cost.join(whole, "component").where(F.col("cost") < F.col("sets") * F.col("blocks")).select("component")
    columns = ["component", "key", "blocks", "keys", "node", "text_hash"]
    together = member.join(whole.join(apart, "component", "left_anti").select("component", "blocks"), "component")
    together = together.withColumn("key", F.lit(None).cast("long")).withColumn("keys", F.lit(None).cast("array<long>"))
    parted = many.join(apart, "component", "left_semi").withColumn("key", F.explode("keys"))
    parted = parted.join(buckets.select("component", "key", "blocks"), ["component", "key"])
    return together.select(*columns).unionByName(parted.select(*columns))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_links, n_copies, class_size, text_hash, stays.

    A text is its sequence of words (runs of non-blanks, A-Z lower-cased); rows of the same
    sequence are copies. Two different sequences are linked when the Jaccard similarity of
    their sets of five-word shingles is at least the threshold; fewer than five words are one
    shingle. n_links counts the other sequences linked to a row's, n_copies the rows of its
    own, class_id is the least id reached over links and copies, class_size its rows; stays
    marks the row of that id (and of the least text_hash, should several texts have it). Null
    and blank texts are copies of one another, linked to nothing. A null id counts only where all
    ids of a class are null. No rows give no rows; other columns are not read.

    Candidates: 240 MinHash values in 40 bands of 6 miss a pair at 0.8 with probability 5e-6.
    Each bucket hangs its members on its least one, which is linear in its size, and the
    components of these stars hold every candidate pair. Components, or their buckets where that
    carries fewer texts, are dealt as pairs of hashed blocks of about BLOCK_SETS sets and
    BLOCK_SHINGLES shingles; inside a pair of blocks, all pairs are compared value by value, dropped once the posterior probability
    of reaching the threshold is under the tolerance, and the rest checked exactly. Only
    counts and stars leave a block, so a large group of near copies never becomes pair rows.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("text_hash"), body.alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = materialise(texts.mapInArrow(_sketch, f"id {kind}, text_hash binary, node binary, shingles long, keys array<long>"))
    nodes = materialise(sketch.where("shingles > 0").groupBy("node").agg(F.min(F.struct("text_hash", "shingles", "keys")).alias("s")).select("node", "s.*"))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    hubs = materialise(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    stars = sieve(keys, "key", hubs.select("key")).join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    member = components(stars).join(nodes.select("node", "text_hash", "shingles"), "node")
    member = materialise(member)
    dealt = _dealt(member, nodes).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    short = F.xxhash64("text_hash")
    wanted = sieve(texts.select("text_hash", "body", short.alias("short")), "short", member.select(short)).select("text_hash", "body")
    # Not a semi join, which the optimiser would move before the sieve; the join below is exact.
    wanted = wanted.dropDuplicates(["text_hash"])
    placed = dealt.join(wanted, "text_hash").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("component", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "body", "keys")
    dealt = placed.repartition(*DEALT_BY).sortWithinPartitions(*DEALT_BY)
    links = materialise(dealt.mapInArrow(_verify(threshold, tolerance), "a binary, links long, b binary"))
    classes = components(links.select("a", "b")).select("node", F.col("component").alias("class"))
    linked = classes.join(links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links")), "node", "left")
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash")
    per_node = sketch.groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("n_copies"))
    per_node = per_node.join(linked, "node", "left").withColumn("class", F.coalesce("class", "node"))
    per_class = per_node.groupBy("class").agg(F.min("first").alias("least"), F.sum("n_copies").alias("class_size"))
    found = per_node.join(per_class, "class").select("node", "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "class_size")
    out = sketch.select("id", "text_hash", "node").join(found, "node")
    return out.select(F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "n_links", "n_copies", "class_size", "text_hash", first.eqNullSafe(F.col("least")).alias("stays"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of a class that do not stay, all columns kept.

    Rows that repeat both id and text are one document and stay or go together.

    The ids and text hashes that go are anti-joined; only where they are few does Spark
    broadcast them, by their size.
    """
    gone = jaccard_join(docs, threshold, tolerance, id_col, text_col).where(~F.col("stays"))
    gone = gone.select(F.col(id_col).alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    text_hash = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("gone_id")) & (text_hash == F.col("gone_text")), "left_anti")
