"""Hierarchical Pitman-Yor language model: word restaurants by context, sharing one parent.

Every word opens a restaurant of its own for what follows it, and so does the start of a text.
Seatings are sampled by Gibbs sweeps, predictive probabilities averaged over samples. Words are
dealt to buckets by their hash; of the words that make up 1 / CONTEXTS of the training tokens
(heavy ones, a matter of layout alone) the seats in other words' restaurants are dealt by context.
Buckets exchange the tables and customers of each context: of heavy ones as arrays of fixed size,
of the others through shards by the context's hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.quality import remainder
from kbspark.llm.shingles import word_hashes
from kbspark.session import materialise, scratch

CONTEXTS = 2048
BUCKET_BYTES = 10 << 20
SLICE_BYTES = 3 << 20
BUCKETS_PER_SHARD = 4
END = np.uint64(0)  # the end token; word hashes are mixed, 0 is as unlikely as any other value
# Words are known by 48 bits: of a thousand million words a few in a million share theirs.
WORD_BITS = np.uint64((1 << 48) - 1)
BURN, SAMPLES = 3, 4
EXACT = 48
# Sums of logarithms travel as whole numbers of this part of one, so their order changes nothing.
UNIT = 1 << 30
STRENGTH = 0.5


@dataclass(frozen=True)
class Totals:
    """What buckets know of one another. c and t have a place for every heavy context, the last for the start."""

    heavy: np.ndarray  # hashes of the heavy words, sorted, END among them
    tokens: int = 0
    words: int = 0
    c: np.ndarray | None = None
    t: np.ndarray | None = None
    root_c: float = 0.0
    root_t: float = 0.0
    discount: float = 0.75
    root_discount: float = 0.75
    # Of heavy words, whose seats are in several buckets: training count, customers and tables in the parent.
    heavy_n: np.ndarray | None = None
    heavy_c: np.ndarray | None = None
    heavy_t: np.ndarray | None = None


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, so that the high bytes of small numbers cost next to nothing."""
    head = ";".join(f"{k} {x.dtype.str} {' '.join(map(str, x.shape))}" for k, x in arrays.items()).encode()
    planes = [np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(x.size, x.itemsize).T.tobytes() for x in arrays.values()]
    return zstandard.compress(b"".join([len(head).to_bytes(2, "little"), head, *planes]), 3)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    data, out = zstandard.decompress(data), {}
    at = 2 + int.from_bytes(data[:2], "little")
    for part in data[2:at].decode().split(";"):
        name, kind, *shape = part.split()
        size, shape = np.dtype(kind).itemsize, tuple(map(int, shape))
        count = int(np.prod(shape, dtype=np.int64))
        end = at + size * count
        planes = np.frombuffer(data[at:end], np.uint8).reshape(size, count)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(shape)
        at = end
    return out


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and ends of all texts, the word before each (END before the first), and its text."""
    words, counts = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), counts + 1)
    last = np.cumsum(counts + 1) - 1
    out = np.empty(len(text), np.uint64)
    out[last] = END
    inner = np.ones(len(text), bool)
    inner[last] = False
    out[inner] = words & WORD_BITS
    before = np.r_[END, out[:-1]]
    return out, before, text


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a slice that make up at least 1 / (4 CONTEXTS) of it, and the slice's tokens as word 0."""
    for batch in batches:
        texts = batch.column("body").to_pylist()
        for start, end in _slices(texts):
            words, counts = np.unique(_tokens(texts[start:end])[0], return_counts=True)
            often = counts * 4 * CONTEXTS >= counts.sum()
            often[words == END] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[END, words[often]].view(np.int64)), pa.array(np.r_[counts.sum(), counts[often]])], ["word", "n"]
            )


def _place(heavy: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word among the heavy ones, -1 for others."""
    at = np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)
    return np.where(heavy[at] == words, at, -1)


def _context(heavy: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Heavy place of the word before; the start of a text has the place after the last."""
    at = _place(heavy, before)
    return np.where(before == END, len(heavy), at).astype(np.int16)


def _deal(heavy: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("body").to_pylist()
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "text_hash")], 1)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for start, end in _slices(texts):
                word, before, text = _tokens(texts[start:end])
                place, context = _place(heavy, word), _context(heavy, before)
                learnt = train[start:end][text]
                slice_id += 1
                # The texts' keys travel once; buckets know a text by its slice and place.
                out = [(slice_id % buckets, _pack(kind=np.array(2), slice=np.array(slice_id), keys=keys[start:end]))]
                # Heavy words after heavy ones: only the slice's counts by (context, word) of training texts leave it.
                often = (place >= 0) & (context >= 0)
                use = often & learnt
                pair, n = np.unique(place[use].astype(np.int64) * 4096 + (context[use] + 1), return_counts=True)
                w, u = heavy[pair // 4096], (pair % 4096 - 1).astype(np.int16)
                home = (w % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(home):
                    m = home == b
                    out.append((int(b), _pack(kind=np.array(0), w=w[m], u=u[m], n=n[m])))
                # Others: every occurrence with its text; heavy words go to their context's bucket.
                w, u, place, before, text = (x[~often] for x in (word, context, place, before, text))
                home = (np.where(place < 0, w, before) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((w, home))
                cuts = np.searchsorted(home[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    m = order[cuts[b] : cuts[b + 1]]
                    values, index = np.unique(w[m], return_inverse=True)
                    docs, doc = np.unique(text[m], return_inverse=True)
                    # Contexts by number: the heavy ones' places, then those of this blob.
                    codes, rare = u[m].astype(np.int64), u[m] < 0
                    hashes, at = np.unique(before[m][rare], return_inverse=True)
                    codes[rare] = len(heavy) + 1 + at
                    steps = {"w": np.diff(values, prepend=END), "ctx": np.diff(hashes, prepend=END), "index": np.diff(index, prepend=0).astype(np.uint32), "docs": np.diff(docs, prepend=0).astype(np.uint32)}
                    out.append((int(b), _pack(kind=np.array(1), u=codes.astype(np.uint32), doc=doc.astype(np.uint32), slice=np.array(slice_id), train=train[start:end][docs], **steps)))
                if out:
                    b, blobs = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list]]:
    """Rows come ordered by the first column: its value, and the rows' other values, blobs still packed."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for key, *row in zip(*columns):
            if (key := key.as_py()) != now and held:
                yield now, held
                held = []
            now = key
            held.append([x.as_py() for x in row])
    if held:
        yield now, held


SUMS = ("stats", "c", "t", "heavy_n", "heavy_c", "heavy_t")
MERGED = "bucket int, data binary, seen binary, " + ", ".join(f"{c} array<long>" for c in SUMS)
SENT = "bucket int, shard int, blob binary"
SETTLED = SENT + ", " + ", ".join(f"{c} array<long>" for c in SUMS)


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in columns], [c for c, _ in columns])


def _merge(heavy: np.ndarray, buckets: int, shards: int):
    """Blobs come ordered by bucket. Out: one row a bucket with its pairs, their texts and first sums."""
    contexts = len(heavy) + 1

    def one(bucket: int, blobs: list[list]) -> dict:
        w, u, n, doc, places, slices, ends, cuts, heavy_w, heavy_u, heavy_n, keys, key_slices, ctx, ctx_n = [], [], [], [], [], [], [0], [0], [], [], [], [], [], [], 0
        while blobs:
            x = _unpack(*blobs.pop())
            if x["kind"] == 0:
                heavy_w.append(x["w"])
                heavy_u.append(x["u"].astype(np.int32))
                heavy_n.append(x["n"].astype(np.int64))
            elif x["kind"] == 2:
                keys.append(x["keys"])
                key_slices.append(np.full(len(x["keys"]), x["slice"]))
            else:
                w.append(np.cumsum(x["w"])[np.cumsum(x["index"], dtype=np.int64)])
                ends.append(ends[-1] + len(w[-1]))
                codes = x["u"].astype(np.int32)
                codes[codes >= contexts] += ctx_n
                u.append(codes)
                ctx.append(np.cumsum(x["ctx"]))
                ctx_n += len(x["ctx"])
                n.append(x["train"][x["doc"]].astype(np.int64))
                doc.append(x["doc"].astype(np.int32) + cuts[-1])
                places.append(np.cumsum(x["docs"], dtype=np.uint32))
                slices.append(int(x["slice"]))
                cuts.append(cuts[-1] + len(x["docs"]))
        join = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)])
        one_each, doc = sum(map(len, w)), join(doc, np.int32)
        del blobs
        every_w, every_u, n = join(w + heavy_w, np.uint64), join(u + heavy_u, np.int32), join(n + heavy_n, np.int64)
        del w, u, heavy_w, heavy_u, heavy_n
        # Contexts of this bucket by shard and hash, numbered after the heavy ones.
        ctx, at = np.unique(join(ctx, np.uint64), return_inverse=True)
        order = np.lexsort((ctx, ctx % np.uint64(shards)))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ctx, rare = ctx[order], every_u >= contexts
        every_u[rare] = contexts + rank[at][every_u[rare] - contexts]
        del order, rank, at, rare
        order = np.lexsort((every_u, every_w))
        sw, su = every_w[order], every_u[order]
        del every_w, every_u
        new = np.r_[True, (sw[1:] != sw[:-1]) | (su[1:] != su[:-1])][: len(sw)]
        pair = np.empty(len(sw), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        pw, pu = sw[new], su[new]
        del sw, su, new
        c = np.bincount(pair, n, len(pw)).astype(np.int64)
        # Occurrences of a slice come by pair, so that their steps are small.
        held = pair[:one_each].astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64)
        for i, j in zip(ends[:-1], ends[1:]):
            held[i:j].sort()
        pair, doc = np.diff((held >> np.uint64(32)).astype(np.int32), prepend=np.int32(0)), held.astype(np.uint32)
        del held
        seen = _pack(pair=pair, doc=doc, places=join(places, np.uint32), slices=np.array(slices, np.int64), cuts=np.array(cuts), keys=np.concatenate([*keys, np.empty((0, 2), np.int64)]), key_slices=join(key_slices, np.int64))
        del pair, doc, n, keys, key_slices, places
        # A heavy word is among the words of its own bucket even if all its seats are in others.
        words = np.union1d(pw, heavy[heavy % np.uint64(buckets) == bucket])
        start = np.searchsorted(pw, words)
        word = np.repeat(np.arange(len(words)), np.diff(np.r_[start, len(pw)]))
        tables, place = np.bincount(word, c > 0, len(words)).astype(np.int64), _place(heavy, words)
        light, often = tables[place < 0], pu < contexts
        sums = {k: np.bincount(pu[often], x[often], contexts) for k, x in (("c", c), ("t", c > 0))}
        sums |= {k: np.bincount(place[place >= 0], x[place >= 0], len(heavy)) for k, x in (("heavy_n", np.bincount(word, c, len(words))), ("heavy_c", tables))}
        sums["stats"] = np.array([c.sum(), tables.sum(), (light > 0).sum(), (light == 1).sum(), (light == 2).sum(), (c == 1).sum(), (c == 2).sum()])
        return {"bucket": bucket, "data": _pack(w=words, start=start.astype(np.int32), u=pu, c=c, ctx=ctx), "seen": seen} | {k: x.astype(np.int64) for k, x in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _groups(batches, "bucket", "blob"):
            yield _batch(MERGED, [one(bucket, blobs)])

    return run


def _by_shard(bucket: int, shards: int, contexts: int, data: dict[str, np.ndarray], t: np.ndarray) -> list[dict]:
    """A bucket's sums in its lighter contexts, a row for every shard of contexts.

    At first customers and tables of all; later, when it is known which contexts no other
    bucket has and that customers stay, only the tables of those that others have as well.
    """
    rare = data["u"] >= contexts
    first = "shared" not in data
    sums = {k: np.bincount(data["u"][rare] - contexts, x[rare], len(data["ctx"])).astype(np.uint32) for k, x in (("c", data["c"]), ("t", t)) if first or k == "t"}
    ctx = data["ctx"]
    if not first:
        ctx, sums = ctx[data["shared"]], {k: x[data["shared"]] for k, x in sums.items()}
    cuts = np.searchsorted(ctx % np.uint64(shards), np.arange(shards + 1))
    return [{"bucket": bucket, "shard": k, "blob": _pack(ctx=np.diff(ctx[i:j], prepend=END), **{n: x[i:j] for n, x in sums.items()})} for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]


def _first_sums(shards: int, contexts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                a = _unpack(data.as_py())
                yield _batch(SENT, _by_shard(bucket, shards, contexts, a, a["c"] > 0))

    return run


def _sum_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard. Out: for every row its contexts' sums over all buckets, in its order."""
    for shard, rows in _groups(batches, "shard", "bucket", "blob"):
        rows = [(bucket, _unpack(x)) for bucket, x in rows]
        at = np.unique(np.concatenate([np.cumsum(x["ctx"]) for _, x in rows]), return_inverse=True)[1]
        sums = {k: np.bincount(at, np.concatenate([x[k] for _, x in rows])).astype(np.uint32)[at] for k in ("c", "t") if k in rows[0][1]}
        if "c" in sums:
            sums["shared"] = np.bincount(at)[at] > 1
        end = 0
        for bucket, x in rows:
            start, end = end, end + len(x["ctx"])
            yield _batch(SENT, [{"bucket": bucket, "shard": shard, "blob": _pack(shard=np.array(shard), **{k: x[start:end] for k, x in sums.items()})}])


def _told(data: dict[str, np.ndarray], blobs: list[bytes]) -> dict[str, np.ndarray]:
    """A bucket's arrays with what was sent to it: sums of its contexts (ctx_c, ctx_t), which are shared, and its state."""
    told, shards = dict(data), []
    for x in map(_unpack, blobs):
        if "shard" in x:
            shards.append(x)
        else:
            told |= x
    shards.sort(key=lambda x: int(x["shard"]))
    join = lambda k, kind: np.concatenate([*(x[k] for x in shards), np.empty(0, kind)])
    if "shared" not in told:
        return told | {"ctx_c": join("c", np.int64), "ctx_t": join("t", np.int64), "shared": join("shared", bool)}
    told["ctx_t"] = told["ctx_t"].astype(np.int64)  # as the bucket left them; those of shared contexts are the sums of all
    told["ctx_t"][told["shared"]] = join("t", np.int64)
    return told


def _stirling(discount: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t), the weight of seating c at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = out[c, t] + np.log(np.maximum(c - discount * t, 1e-300))
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def _seat(rng: np.random.Generator, c: np.ndarray, x: np.ndarray, discount: float, table: np.ndarray) -> np.ndarray:
    """Tables t of dishes with c customers, drawn from weights S(c, t) exp(x t).

    exp(x) is (strength + discount * tables of the restaurant) * parent's probability of the
    dish. Up to EXACT customers the conditional is drawn as it stands; later customers are
    seated one group after the other, groups being a fiftieth of those already seated.
    """
    t = np.minimum(c, 1)
    first = np.minimum(c, EXACT)
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(EXACT + 2))
    for k in range(2, EXACT + 1):
        rows = order[cuts[k] : cuts[k + 1]]
        for at in range(0, len(rows), 1 << 15):
            part = rows[at : at + (1 << 15)]
            weight = table[k, 1 : k + 1][None, :] + x[part, None] * np.arange(1, k + 1)
            weight = np.exp(weight - weight.max(1, keepdims=True))
            total = np.cumsum(weight, 1)
            t[part] = 1 + (total < rng.random(len(part))[:, None] * total[:, -1:]).sum(1)
    rows, seated = np.flatnonzero(c > EXACT), EXACT
    while len(rows):
        group = np.minimum(max(1, seated // 50), c[rows] - seated)
        opens = np.exp(x[rows])
        t[rows] += rng.binomial(group, opens / (opens + np.maximum(seated - discount * t[rows], 1e-9)))
        seated += max(1, seated // 50)
        rows = rows[c[rows] > seated]
    return t


class _Bucket:
    """The seats of one bucket's words, and sweeps over them with the other buckets' sums held still."""

    def __init__(self, bucket: int, data: dict[str, np.ndarray], totals: Totals, buckets: int = 1) -> None:
        self.a, self.g = data, totals
        self.rng = np.random.default_rng([12 if "state_t" in data else 11, bucket])
        u, c, none = data["u"], data["c"], np.empty(0, np.int64)
        self.word = np.repeat(np.arange(len(data["w"])), np.diff(np.r_[data["start"], len(u)]))
        self.own = u >= 0
        self.t = data.get("state_t", np.where(self.own, np.minimum(c, 1), 0)).astype(np.int64)
        self.direct = np.bincount(self.word, np.where(self.own, 0, c), len(data["w"])).astype(np.int64)
        self.base = 1.0 / (totals.words + 1)
        # The sums of the others: all sums less what this bucket has put into them.
        self.customers = np.r_[totals.c, data.get("ctx_c", none)]
        self.rest_t = np.r_[totals.t, data.get("ctx_t", none)]
        self.rest_t = self.rest_t - self._by_context(self.t)
        own_c = self.tables_of_words()
        self.place, self.rest_c = np.full(len(own_c), -1), np.zeros(len(own_c), np.int64)
        self.home = data["w"] % np.uint64(buckets) == np.uint64(bucket % buckets)
        if totals.heavy_c is not None:
            self.place = _place(totals.heavy, data["w"])
            self.home |= self.place < 0
            split = self.place >= 0
            self.rest_c[split] = totals.heavy_c[self.place[split]] - own_c[split]
        self.root_c = own_c + self.rest_c
        self.root_t = np.minimum(self.root_c, 1)
        if "state_root" in data:
            self.root_t = data["state_root"].astype(np.int64)
        away = ~self.home
        if away.any():
            self.root_t[away] = totals.heavy_t[self.place[away]]
        self.rest_root_c, self.rest_root_t = totals.root_c - own_c.sum(), totals.root_t - self.root_t[self.home].sum()
        self.tables = _stirling(totals.discount, EXACT), _stirling(totals.root_discount, EXACT)

    def _by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.a["u"][self.own], x[self.own], len(self.rest_t))

    def tables_of_words(self) -> np.ndarray:
        """What this bucket's seats put into the parent."""
        return self.direct + np.bincount(self.word, self.t, len(self.direct)).astype(np.int64)

    def sums(self) -> tuple[float, float]:
        """Customers and tables of the whole parent."""
        return self.rest_root_c + (self.root_c - self.rest_c).sum(), self.rest_root_t + self.root_t[self.home].sum()

    def parent(self) -> np.ndarray:
        """Predictive probability of each word in the parent restaurant."""
        g = self.g
        c, t = self.sums()
        return (self.root_c - g.root_discount * self.root_t + (STRENGTH + g.root_discount * t) * self.base) / (STRENGTH + c)

    def contexts(self) -> np.ndarray:
        return self.rest_t + self._by_context(self.t)

    def sweep(self) -> None:
        g, c, u = self.g, self.a["c"], self.a["u"]
        p = self.parent()
        rows = np.flatnonzero(self.own & (c > 1))
        x = np.log(STRENGTH + g.discount * self.contexts()[u[rows]]) + np.log(p[self.word[rows]])
        self.t[rows] = _seat(self.rng, c[rows], x, g.discount, self.tables[0])
        self.root_c = self.tables_of_words() + self.rest_c
        home = np.flatnonzero(self.home)
        x = np.full(len(home), np.log(STRENGTH + g.root_discount * self.sums()[1]) + np.log(self.base))
        self.root_t[home] = _seat(self.rng, self.root_c[home], x, g.root_discount, self.tables[1])

    def predictive(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every pair, given its context; and of every word in the parent."""
        g, c, u, p = self.g, self.a["c"], self.a["u"], self.parent()
        total, tables = self.customers[u], self.contexts()[u]
        own = (c - g.discount * self.t + (STRENGTH + g.discount * tables) * p[self.word]) / (STRENGTH + total)
        return np.where(self.own & (total > 0), own, p[self.word]), p


def _settle(totals: Totals, buckets: int, shards: int):
    """Burn in, and report the seats and the sums this ends with."""
    contexts = len(totals.heavy) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data, told in zip(batch.column("bucket").to_pylist(), batch.column("data"), batch.column("told")):
                a = _told(_unpack(data.as_py()), told.as_py() or [])
                b = _Bucket(bucket, a, totals, buckets)
                for _ in range(BURN):
                    b.sweep()
                own_c, heavy = b.root_c - b.rest_c, b.place >= 0
                sums = {"stats": [int(own_c.sum()), int(b.root_t[b.home].sum())], "t": b._by_context(b.t)[:contexts].astype(np.int64)}
                for k, x in (("heavy_c", own_c), ("heavy_t", np.where(b.home, b.root_t, 0))):
                    sums[k] = np.bincount(b.place[heavy], x[heavy], len(totals.heavy)).astype(np.int64)
                own_t = b._by_context(b.t)[contexts:].astype(np.uint32)
                state = {"bucket": bucket, "shard": -1, "blob": _pack(state_t=b.t.astype(np.uint32), state_root=b.root_t.astype(np.uint32), ctx_c=a["ctx_c"].astype(np.uint32), ctx_t=own_t, shared=a["shared"])}
                yield _batch(SETTLED, [state | sums, *_by_shard(bucket, shards, contexts, a, b.t)])

    return run


SCORES = "slice long, word int, context int, score double, blob binary"


def _score(totals: Totals, buckets: int):
    """The chain goes on: averaged predictive probabilities, summed by text; heavy words after heavy ones as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCORES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

        for batch in batches:
            for bucket, data, seen, told in zip(batch.column("bucket").to_pylist(), batch.column("data"), batch.column("seen"), batch.column("told")):
                a = _told(_unpack(data.as_py()) | _unpack(seen.as_py()), told.as_py() or [])
                b = _Bucket(bucket, a, totals, buckets)
                pairs, words = np.zeros(len(a["u"])), np.zeros(len(a["w"]))
                for _ in range(SAMPLES):
                    b.sweep()
                    p, q = b.predictive()
                    pairs += p / SAMPLES
                    words += q / SAMPLES
                count = np.where(b.place < 0, np.bincount(b.word, a["c"], len(a["w"])), totals.heavy_n[b.place])
                base = np.log10(count + 1)
                doc, pair, k = a["doc"].astype(np.int64), np.cumsum(a["pair"], dtype=np.int64), len(a["places"])
                w = b.word[pair]
                sums = {"n": np.bincount(doc, minlength=k).astype(np.uint32), "known": np.bincount(doc, count[w] > 0, k).astype(np.uint32), "base": np.bincount(doc, base[w], k), "score": -np.bincount(doc, np.log10(pairs)[pair], k)}
                sums |= {c: np.rint(sums[c] * UNIT).astype(np.int64) for c in ("base", "score")}
                cuts = a["cuts"]
                blobs = [_pack(places=a["places"][i:j], **{c: x[i:j] for c, x in sums.items()}) for i, j in zip(cuts[:-1], cuts[1:])]
                if blobs:
                    yield rows(slice=a["slices"], blob=blobs)
                ends = np.flatnonzero(np.r_[np.diff(a["key_slices"]) != 0, True])[: len(a["keys"])]
                if len(ends):
                    yield rows(slice=a["key_slices"][ends], blob=[_pack(keys=a["keys"][i:j]) for i, j in zip(np.r_[0, ends[:-1] + 1], ends + 1)])
                hw = np.flatnonzero((b.place >= 0) & b.home)
                pick = np.flatnonzero((b.place[b.word] >= 0) & (a["u"] <= len(totals.heavy)))
                # Heavy words: a row for each pair, and one for each word in the parent (context -2).
                if len(hw):
                    yield rows(
                        word=np.r_[b.place[b.word[pick]], b.place[hw]],
                        context=np.r_[a["u"][pick].astype(np.int32), np.full(len(hw), -2, np.int32)],
                        score=np.r_[pairs[pick], words[hw]],
                    )

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs come ordered by slice: its texts' keys and, from each bucket, sums by place."""
    names = ("n", "known", "base", "score")

    def out(blobs: list[dict]) -> pa.RecordBatch:
        keys = next(x["keys"] for x in blobs if "keys" in x)
        sums = {c: np.zeros(len(keys), np.int64) for c in names}
        for x in blobs:
            for c in names if "keys" not in x else ():
                sums[c][x["places"]] += x[c].astype(np.int64)
        logs = [pa.array(sums["base"] / UNIT), pa.array(-sums["score"] / UNIT)]
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sums["n"]), pa.array(sums["known"]), *logs], ["id", "text_hash", *names])

    now, held = None, []
    for batch in batches:
        for key, blob in zip(batch.column("slice").to_pylist(), batch.column("blob")):
            if key != now and held:
                yield out(held)
                held = []
            now = key
            held.append(_unpack(blob.as_py()))
    if held:
        yield out(held)


def _heavy_part(heavy: np.ndarray, log_p: np.ndarray, base: np.ndarray, known: np.ndarray):
    """Of every text: its tokens, and the sums over its heavy tokens after heavy ones from the table log_p[context, word]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").to_pylist()
            for start, end in _slices(texts):
                word, before, text = _tokens(texts[start:end])
                place, context = _place(heavy, word), _context(heavy, before)
                k, at = end - start, (place >= 0) & (context >= 0)
                w, u, d = place[at], context[at], text[at]
                n = np.bincount(text, minlength=k)
                sums = [n, n - np.bincount(d, minlength=k), np.bincount(d, known[w], k).astype(np.int64), *(np.bincount(d, x, k).astype(np.float64) for x in (base[w], log_p[u, w]))]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, k), *map(pa.array, sums)], ["row", "n", "rare", "known", "base", "score"])

    return run


def _kept_by_bucket(df: DataFrame, parts: int) -> DataFrame:
    """As materialise(), with rows filed by bucket, so that joins on it leave them where they are."""
    name = f"kb_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, "bucket").sortBy("bucket").option("path", scratch(df.sparkSession)).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def _sum_lists(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Sums by place of array columns; as many rows reach the driver as an array has places."""
    out = []
    for name in names:
        rows = df.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        out.append(np.array([r.x for r in rows], np.float64))
    return out


def _discount(once: float, twice: float) -> float:
    """The usual estimate from the numbers of counts 1 and 2, kept inside (0, 1)."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity.

    The model learns from the rows where `training` holds (null: not). Words are runs of
    non-blanks, A-Z lower-cased; a text's end is its last token. base_score adds one to the
    training counts of the V words and of one unknown. score sums the log10 of probabilities
    averaged over SAMPLES seatings; perplexity is 10 ** (-score / n_tokens). Null text is
    empty, which is one end. Rows that repeat id and text share sums and get the same score.
    Without training rows every token has probability 1. No rows give no rows.

    Text is read three times and never shuffled: occurrences of words below 1 / CONTEXTS, or
    after such words, go to their bucket as packed arrays, buckets of about BUCKET_BYTES of
    text each, and sums by text come back; frequent words after frequent ones send counts only
    and are scored beside the text from a table bounded by CONTEXTS squared. Buckets keep their
    rows: only sums by context travel between rounds. Draws depend on bucket and seed alone.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.coalesce(F.col(id_col).cast("long") if whole else F.xxhash64(id_col), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("body"), F.coalesce(training, F.lit(False)).alias("train"), F.col(id_col).alias("own"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("n")).first().n or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    shards = -(-buckets // BUCKETS_PER_SHARD)
    often = rows.where("train").select("body").mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "word").limit(CONTEXTS + 1).collect()  # no more than CONTEXTS words reach the share
    total = next((r.n for r in often if r.word == 0), 0)
    heavy = np.unique(np.array([0] + [r.word for r in often if r.n * CONTEXTS >= total], np.int64).view(np.uint64))
    contexts = len(heavy) + 1
    blobs = rows.mapInArrow(_deal(heavy, buckets), "bucket int, blob binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    merged = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(heavy, buckets, shards), MERGED)
    merged = _kept_by_bucket(merged, parts)

    def told(sent: DataFrame, *more: DataFrame) -> DataFrame:
        """Buckets beside what shards, or they themselves before, have sent them."""
        replies = sent.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_sum_shards, SENT).select("bucket", "blob")
        for x in more:
            replies = replies.unionByName(x)
        replies = replies.repartition(parts, "bucket").groupBy("bucket").agg(F.collect_list("blob").alias("told"))
        return merged.select("bucket", "data", "seen").join(replies.hint("merge"), "bucket", "left")

    stats, c, t, heavy_n, heavy_c = _sum_lists(merged, "stats", "c", "t", "heavy_n", "heavy_c")
    if not len(stats):
        stats, c, t, heavy_n, heavy_c = np.zeros(7), np.zeros(contexts), np.zeros(contexts), np.zeros(len(heavy)), np.zeros(len(heavy))
    words = int(stats[2] + (heavy_c > 0).sum())
    root_discount = _discount(*(stats[2 + k] + (heavy_c == k).sum() for k in (1, 2)))
    first = Totals(heavy, int(stats[0]), words, c, t, stats[1], words, _discount(*stats[5:7]), root_discount, heavy_n, heavy_c, np.minimum(heavy_c, 1))
    sent = merged.select("bucket", "data").mapInArrow(_first_sums(shards, contexts), SENT)
    state = materialise(told(sent).select("bucket", "data", "told").mapInArrow(_settle(first, buckets, shards), SETTLED))
    root, t, heavy_c, heavy_t = _sum_lists(state, "stats", "t", "heavy_c", "heavy_t")
    settled = replace(first, t=t, root_c=root[0], root_t=root[1], heavy_c=heavy_c, heavy_t=heavy_t) if len(root) else first
    seats = told(state.where("shard >= 0").select("bucket", "shard", "blob"), state.where("shard < 0").select("bucket", "blob"))
    sums = materialise(seats.mapInArrow(_score(settled, buckets), SCORES))
    # At most CONTEXTS * (CONTEXTS + 3) rows of 16 bytes.
    word, context, value = (x.to_numpy() for x in sums.where("word is not null").select("word", "context", "score").toArrow().columns)
    p = np.full(len(heavy), 1.0 / (first.words + 1))
    p[word[context == -2]] = value[context == -2]
    base = np.log10(heavy_n + 1)
    back = np.where(c > 0, (STRENGTH + first.discount * settled.t) / (STRENGTH + c), 1.0)
    prob = back[:, None] * p[None, :]
    prob[context[context != -2], word[context != -2]] = value[context != -2]
    kind = docs.schema[id_col].dataType.simpleString()
    light = rows.select(F.struct("own", "id", "text_hash").alias("row"), "body")
    light = light.mapInArrow(_heavy_part(heavy, np.log10(prob), base, (heavy_n > 0).astype(float)), f"row struct<own:{kind},id:long,text_hash:long>, n long, rare long, known long, base double, score double")
    rare = sums.where("blob is not null").select("slice", "blob").repartition("slice").sortWithinPartitions("slice").mapInArrow(_gather, "id long, text_hash long, n long, known long, base double, score double")
    rare = rare.groupBy("id", "text_hash").agg(F.sum("n").alias("all"), F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    out = light.select("row.own", "row.id", "row.text_hash", "n", "rare", "known", "base", "score").join(rare, ["id", "text_hash"], "left")
    share = F.coalesce(F.col("rare") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0))  # below 1 where rows repeat
    norm = float(np.log10(first.tokens + first.words + 1))
    return out.select(
        F.col("own").alias(id_col),
        F.col("n").alias("n_tokens"),
        F.round(F.col("known") + F.coalesce(F.col("k"), F.lit(0)) * share).cast("long").alias("n_known"),
        F.lit(first.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("b"), F.lit(0.0)) * share - F.col("n") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("s"), F.lit(0.0)) * share).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(key: Column, mod: int = 7) -> Column:
    return remainder(key, mod) == 2
