"""Best-fit packing after a Martello-Toth dominance reduction, both on counts by length."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import materialise

END_OF_TEXT = "<|endoftext|>"


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str) -> Callable[[str], np.ndarray]:
    """text -> ids by tokenizers and byte_bpe_50k.json, "<|endoftext|>" inside a text being its special token.

    Where the same merges lie beside the file as .tiktoken, texts are encoded by that library
    at four times the speed. It gives the same ids (tests hold both against each other, on
    every character as well) but refuses some texts, such as a million blanks in a row; those
    go to tokenizers.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    exact = lambda text: np.array(model.encode(text, add_special_tokens=False).ids, "<u4")
    merges = f"{os.path.splitext(vocabulary)[0]}.tiktoken"
    if not os.path.exists(merges):
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(merges, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {END_OF_TEXT: 50256}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids_of(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode(text, allowed_special=set(special), disallowed_special=()), "<u4")
        except ValueError:  # its pattern's search gave up
            return exact(text)

    return ids_of


def _cutter(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = byte_bpe(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("body").to_pylist()):
                ids = np.append(ids_of(text or ""), np.array([end_id], "<u4"))
                first = len(ids) % capacity or min(len(ids), capacity)
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if k == 0 else at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            columns = [batch.column("row").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, keep: list[str], capacity: int = 1024, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """The columns `keep` and piece, start, length, ids_crc32 of every piece of every text.

    A text's ids and the end id are cut, where longer than capacity, into pieces of exactly
    capacity but for the first. Null is empty text, whose only id is the end; a text of any
    length is encoded whole. A column of `keep` that has the name of an added one is an error
    that names it. No rows give no rows. No shuffle.
    """
    if clash := set(keep) & {"piece", "start", "length", "ids_crc32", "sequence_id", "offset"}:
        raise ValueError(f"columns {sorted(clash)} would be there twice: rename them first")
    rows = docs.select(F.struct(*[F.col(c).alias(c) for c in keep]).alias("row"), F.col(text_col).alias("body"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(_cutter(vocabulary, capacity, end_id), schema).select("row.*", "piece", "start", "length", "ids_crc32")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins fixed by dominance, as (lengths, number of such bins), and the counts left.

    For an item j, from the longest: k is the most of the shortest others that fit beside it
    and p the longest other that fits. {j} is fixed if k = 0; {j, p} if it fills the bin, if
    k = 1, or if k = 2 and p is no shorter than any two others that fit together, since p then
    can stand for what else would be there. Each holds for all equal items at once, as taking
    items away lowers k and what pairs reach, and p lasts until its count is used up.
    """
    left = {s: n for s, n in counts.items() if n}
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)

    def take(bin_: tuple[int, ...], n: int) -> None:
        fixed.append((bin_, n))
        for s in bin_:
            left[s] -= n
        for s in set(bin_):
            if not left[s]:
                del left[s], sizes[bisect_left(sizes, s)]

    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            others = lambda s: left[s] - (s == j)
            low = []
            for s in sizes:
                low += [s] * min(3, others(s))
                if len(low) >= 3 or s > room:
                    break
            k = int(len(low) > 0 and low[0] <= room) + int(len(low) > 1 and sum(low[:2]) <= room) + int(len(low) > 2 and sum(low[:3]) <= room)
            if k == 0:
                take((j,), left[j])
                break
            at = bisect_left(sizes, room + 1) - 1
            p = sizes[at] if others(sizes[at]) else sizes[at - 1]
            pairs = left[j] // 2 if p == j else min(left[j], left[p])
            if p == room or k == 1 or (k == 2 and p >= _best_pair(sizes, others, room)):
                take((j, p), pairs)
            else:
                break
    return fixed, left


def _best_pair(sizes: list[int], others: Callable[[int], int], room: int) -> int:
    """The largest sum of two other items within room."""
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        a, b = sizes[low], sizes[high]
        if not others(a) or (low == high and others(a) < 2):
            low += 1
        elif not others(b) or a + b > room:
            high -= 1
        else:
            best = max(best, a + b)
            low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, equal items and equal bins handled together: (lengths, number of bins)."""
    bins: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, number]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in bins or not bins[room]:
            insort(rooms, room)
        bins[room].append([lengths, n])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                lengths, number = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
            else:
                room, lengths, number = capacity, (), n
            each = room // size  # best fit returns to the bin it has just put an item in
            full = min(number, n // each)
            if full:
                put(room - each * size, lengths + (size,) * each, full)
                n -= full * each
            if n and full < number:
                put(room - n * size if n < each else room - each * size, lengths + (size,) * min(n, each), 1)
                full += 1
                n -= min(n, each)
            if full < number and (lengths or at < len(rooms)):
                if lengths:
                    put(room, lengths, number - full)
    return [(tuple(lengths), n) for found in bins.values() for lengths, n in found]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from_rank, to_rank, sequence, each, offset) that seat the pieces of each length by rank.

    A run gives ranks from_rank..to_rank-1 of its length to the bins from `sequence` on,
    `each` to a bin, gapless from `offset`. Lengths are at most capacity many, so counts and
    runs are bounded whatever the number of pieces.
    """
    fixed, left = reduce_dominated(counts, capacity)
    rank: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for lengths, n in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            each = lengths.count(size)
            runs.append((size, rank[size], rank[size] + n * each, sequence, each, offset))
            rank[size] += n * each
            offset += size * each
        sequence += n
    return runs


def pack(pieces: DataFrame, keep: list[str], capacity: int = 1024, rows_per_rank: int = 100_000) -> DataFrame:
    """`pieces` (columns keep, piece, start, length, ids_crc32) with sequence_id and offset.

    Only the counts by length, at most `capacity` rows, reach the driver; the plan made of
    them is broadcast: its runs are bounded by capacity, not by the data. A piece finds its
    place by its rank among those of its length. Ranks are counted in hashed parts of about
    rows_per_rank pieces, so that a length shared by a third of all pieces is dealt out; each
    part starts after the sum of the parts before it. Equal pieces are ranked in any order,
    which changes no result. Repeated rows are pieces of their own. No pieces give no rows.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(plan_bins(counts, capacity), "length long, from_rank long, to_rank long, sequence long, each long, at long")
    parts = max(1, -(-max(counts.values(), default=0) // rows_per_rank))
    part = F.pmod(F.xxhash64(*keep, "piece", "ids_crc32"), F.lit(parts)).cast("int")
    dealt = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    sums = sums.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(*keep, "piece", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(sums, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))).drop(runs["length"])
    nth = F.col("rank") - F.col("from_rank")
    return placed.select(
        *keep,
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
