"""Hard-negative mining: a GNAT-style tree of split points with distance ranges, exact leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kbspark.session import materialise

SCALE = 256
# A quantised component beyond this is held at it; scores beyond a long at the largest long.
MOST_COMPONENT = 1 << 53
MOST_SCORE = (1 << 63) - 1
# The tree: at most FAN_OUT ** 2 leaves, planted from at most SAMPLE_ROWS rows and SAMPLE_BYTES.
FAN_OUT, LEAF_ROWS = 32, 8192
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 16 << 20
# A leaf's rows are dealt over blocks of about so many rows and bytes; a task holds one block.
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20
CHUNK = 64


def _pack(q: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: the width, then every number in that many bytes."""
    most = int(np.abs(q).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    data = q.astype(f"<i{width}")
    return [bytes([width]) + row.tobytes() for row in data]


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of _pack() as one matrix; a shorter vector is followed by zeros."""
    out = np.zeros((len(column), dim), np.int64)
    if not len(column):
        return out
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    widths, sizes = data[ends[:-1]], np.diff(ends) - 1
    for width, size in set(zip(widths.tolist(), sizes.tolist())):
        rows = np.flatnonzero((widths == width) & (sizes == size))
        held = data[ends[rows][:, None] + 1 + np.arange(size)]
        out[rows, : size // width] = np.ascontiguousarray(held).view(f"<i{width}")
    return out


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a finite vector, every component x as floor(SCALE * x)."""
    for batch in batches:
        lists = batch.column("v")
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        odd = np.r_[0, np.cumsum(~np.isfinite(values))]
        use = np.asarray(lists.is_valid()) & (odd[ends] == odd[ends - sizes])
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.clip(np.nan_to_num(np.floor(values * SCALE)), -MOST_COMPONENT, MOST_COMPONENT).astype(np.int64)
        packed, rows = [], np.flatnonzero(use)
        for i in rows:
            packed += _pack(q[None, ends[i] - sizes[i] : ends[i]])
        kept = batch.select(["id", "label", "anchor"]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes[rows], pa.int32()), pa.array(packed, pa.binary())], ["id", "label", "anchor", "dim", "v"])


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: floating point only where it can't round."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0))
    if most < 1 << 24:
        return (a.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ x.astype(object).T
    return np.clip(exact, -MOST_SCORE, MOST_SCORE).astype(np.int64)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Node:
    """Split points; a row belongs to the nearest one's subtree. children: nodes, or ~leaf."""

    points: np.ndarray
    children: list[int]
    # From split point i to the rows of subtree j, and the lengths of those rows.
    near: np.ndarray = field(init=False)
    far: np.ndarray = field(init=False)
    shortest: np.ndarray = field(init=False)
    longest: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        k = len(self.points)
        self.near, self.far = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        self.shortest, self.longest = np.full(k, np.inf), np.full(k, -np.inf)

    def widen(self, x: np.ndarray, apart: np.ndarray, nearest: np.ndarray) -> None:
        length = np.sqrt((x * x).sum(1))
        for j in np.unique(nearest):
            rows = nearest == j
            self.near[:, j] = np.minimum(self.near[:, j], apart[rows].min(0))
            self.far[:, j] = np.maximum(self.far[:, j], apart[rows].max(0))
            self.shortest[j], self.longest[j] = min(self.shortest[j], length[rows].min()), max(self.longest[j], length[rows].max())

    def reached(self, q: np.ndarray, apart: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Subtrees that may hold a row of score low..high (one window a row of q).

        |q - x| ** 2 = |q| ** 2 + |x| ** 2 - 2 * score, so a window of scores is an annulus of
        distances around q. A subtree goes if for any split point the distances that its range
        allows miss the annulus.
        """
        square = (q * q).sum(1)[:, None]
        slack = 1e-6 * (1 + square + np.where(np.isfinite(self.longest), self.longest, 0)[None, :] ** 2)
        with np.errstate(invalid="ignore"):
            outer = np.sqrt(np.maximum(square + self.longest[None, :] ** 2 - 2 * low[:, None] + slack, 0))
            inner = np.sqrt(np.maximum(square + self.shortest[None, :] ** 2 - 2 * high[:, None] - slack, 0))
        # What rounding may put into a distance grows with the lengths of both ends.
        loose = np.sqrt(slack) * 1e-3 + 1e-6 * np.sqrt((self.points**2).sum(1).max())
        least = np.maximum(np.maximum(apart[:, :, None] - self.far[None], self.near[None] - apart[:, :, None]), 0).max(1)
        most = (apart[:, :, None] + self.far[None]).min(1)
        return (self.longest >= 0)[None, :] & (least <= outer + loose) & (most >= inner - loose)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of 3k candidates, each next one farthest from those taken; fewer if they repeat."""
    some = np.unique(x[rng.permutation(len(x))[: 3 * k]], axis=0)
    taken, apart = [int(rng.integers(len(some)))], None
    while len(taken) < min(k, len(some)):
        d = _distances(some, some[taken[-1:]])[:, 0]
        apart = d if apart is None else np.minimum(apart, d)
        if apart.max() <= 0:
            break
        taken.append(int(apart.argmax()))
    return some[taken]


class Tree:
    def __init__(self, sample: np.ndarray, rows: int) -> None:
        """Planted from a sample of `rows` rows; two levels where one would leave leaves too large."""
        rng, self.nodes, self.leaves = np.random.default_rng(11), [], 0
        wanted = max(1, -(-rows // LEAF_ROWS))
        depth = 1 if wanted <= FAN_OUT else 2
        fan = min(FAN_OUT, max(8, int(np.ceil(wanted ** (1 / depth)))))
        self._grow(sample, depth, fan, rng)

    def _grow(self, x: np.ndarray, depth: int, fan: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        node = Node(_spread(x, fan, rng), [])
        self.nodes.append(node)
        mine = _distances(x, node.points).argmin(1)
        for j in range(len(node.points)):
            part = x[mine == j]
            if depth > 1 and len(part) > 1:
                node.children.append(self._grow(part, depth - 1, fan, rng))
            else:
                node.children.append(~self.leaves)
                self.leaves += 1
        return at

    def leaf_of(self, x: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of every row; seen(node, rows, distances, nearest) is told each step."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            apart = _distances(x[rows], node.points)
            nearest = apart.argmin(1)
            if seen:
                seen(at, rows, apart, nearest)
            for j in np.unique(nearest):
                some, child = rows[nearest == j], node.children[j]
                if child < 0:
                    out[some] = ~child
                else:
                    todo.append((child, some))
        return out

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Matrix of the leaves that may hold a row in one of the windows (columns of low, high) of q."""
        out = np.zeros((len(q), self.leaves), bool)
        todo = [(0, np.arange(len(q)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            apart = _distances(q[rows], node.points)
            hit = np.zeros((len(rows), len(node.points)), bool)
            for w in range(low.shape[1]):
                open_ = np.flatnonzero(low[rows, w] <= high[rows, w])
                hit[open_] |= node.reached(q[rows[open_]], apart[open_], low[rows[open_], w], high[rows[open_], w])
            for j, child in enumerate(node.children):
                some = rows[hit[:, j]]
                if child < 0:
                    out[some, ~child] = True
                elif len(some):
                    todo.append((child, some))
        return out


def _best(r: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest s of every r; r is in order and ties keep theirs."""
    order = np.lexsort((-s, r))
    r = r[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[rank < k]


@dataclass
class _Search:
    """What every task knows: the tree, the blocks of each leaf, the sample, and the numbers asked for."""

    tree: Tree
    blocks: np.ndarray
    dim: int
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    positives: int
    negatives: int
    low: int
    high: int

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their place: a block of their leaf."""
        before = np.r_[0, np.cumsum(self.blocks)]
        for batch in batches:
            leaf = self.tree.leaf_of(unpack(batch.column("v"), self.dim).astype(float))
            place = before[leaf] + np.asarray(batch.column("slot")) % self.blocks[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *batch.select(["id", "label", "v"]).columns], ["place", "id", "label", "v"])

    def _asking(self, batches: Iterator[pa.RecordBatch], windows) -> Iterator[pa.RecordBatch]:
        """Anchors at the places they have to see: windows(anchors, vectors) gives low, high and what is told with them."""
        before = np.r_[0, np.cumsum(self.blocks)]
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                piece = batch.slice(at, CHUNK)
                q = unpack(piece.column("v"), self.dim)
                low, high, told = windows(piece, q)
                row, leaf = np.nonzero(self.tree.search(q.astype(float), low, high))
                n = self.blocks[leaf]
                place = np.repeat(before[leaf], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out = pa.RecordBatch.from_arrays([*piece.columns, *told.values()], [*piece.schema.names, *told]).take(pa.array(np.repeat(row, n)))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *out.columns], ["place", *out.schema.names])

    def ask_positives(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors at the places that may hold one of their nearest rows of the same label."""

        def windows(piece, q):
            s, none = scores(q, self.sample), np.iinfo(np.int64).min
            ids, labels = np.asarray(piece.column("id")), np.asarray(piece.column("label"))
            s[(self.sample_labels[None] != labels[:, None]) | (self.sample_ids[None] == ids[:, None])] = none
            least = np.partition(s, -self.positives, 1)[:, -self.positives] if s.shape[1] >= self.positives else np.full(len(q), none)
            low = np.where(least == none, -np.inf, least.astype(float))
            return low[:, None], np.full((len(q), 1), np.inf), {"least": pa.array(least)}

        return self._asking(batches, windows)

    def ask_negatives(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors at the places that may hold rows of another label in one of their windows."""
        clip = lambda x: max(-MOST_SCORE, min(MOST_SCORE, x))

        def windows(piece, q):
            s, labels, found = scores(q, self.sample), piece.column("label").to_pylist(), piece.column("positive_scores").to_pylist()
            least = [[clip(-(-self.low * p // 100)) for p in ps] for ps in found]
            most = [[clip(self.high * p // 100) for p in ps] for ps in found]
            width = max(1, max(map(len, found)))
            # A window beyond an anchor's positives is empty: low above high.
            low, high = np.full((len(q), width), np.inf), np.full((len(q), width), -np.inf)
            for i, (a, b) in enumerate(zip(least, most)):
                others = s[i][self.sample_labels != labels[i]]
                for w in range(len(a)):
                    inside = others[(others >= a[w]) & (others <= b[w])]
                    if len(inside) >= self.negatives:
                        a[w] = int(np.partition(inside, -self.negatives)[-self.negatives])
                    low[i, w], high[i, w] = a[w], np.inf if b[w] == MOST_SCORE else b[w]
            kind = pa.list_(pa.int64())
            return low, high, {"least": pa.array(least, kind), "most": pa.array(most, kind)}

        return self._asking(batches, windows)

    def _meet(self, batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
        """Rows come by place, those of the block first: answer(anchors, their vectors, block) for each piece of a batch."""
        place, held, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            places, asked = np.asarray(batch.column("place")), np.asarray(batch.column("asks"))
            cuts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (asked[1:] != asked[:-1])])
            for at, to in zip(cuts, np.r_[cuts[1:], len(places)]):
                piece = batch.slice(at, to - at)
                vectors = unpack(piece.column("v"), self.dim)
                if places[at] != place:
                    place, held, block = places[at], [], None
                if not asked[at]:
                    held.append((np.asarray(piece.column("id")), np.asarray(piece.column("label")), vectors))
                    continue
                if held:
                    ids, labels, x = (np.concatenate(part) for part in zip(*held))
                    order = np.argsort(ids, kind="stable")
                    held, block = [], (ids[order], labels[order], x[order])
                for start in range(0, len(piece) if block else 0, CHUNK):
                    if (out := answer(piece.slice(start, CHUNK), vectors[start : start + CHUNK], block)) is not None:
                        yield out

    def positives_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(piece, q, block):
            ids, labels, x = block
            s = scores(q, x)
            mine = (s >= np.asarray(piece.column("least"))[:, None]) & (np.asarray(piece.column("label"))[:, None] == labels) & (np.asarray(piece.column("id"))[:, None] != ids)
            row, column = np.nonzero(mine)
            best = _best(row, s[row, column], self.positives)
            row, column = row[best], column[best]
            if not len(row):
                return None
            return pa.RecordBatch.from_arrays([piece.column("slot").take(pa.array(row)), pa.array(ids[column]), pa.array(s[row, column])], ["slot", "positive_id", "positive_score"])

        return self._meet(batches, answer)

    def negatives_of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"]

        def answer(piece, q, block):
            ids, labels, x = block
            s = scores(q, x)
            least, most = piece.column("least").to_pylist(), piece.column("most").to_pylist()
            lowest, highest = (np.array([f(v) if v else e for v in side]) for side, f, e in ((least, min, MOST_SCORE), (most, max, -MOST_SCORE)))
            row, column = np.nonzero((s >= lowest[:, None]) & (s <= highest[:, None]) & (np.asarray(piece.column("label"))[:, None] != labels))
            value, out = s[row, column], []
            for w in range(max(map(len, least), default=0)):
                a, b = (np.array([v[w] if len(v) > w else e for v in side]) for side, e in ((least, MOST_SCORE), (most, -MOST_SCORE)))
                inside = np.flatnonzero((value >= a[row]) & (value <= b[row]))
                out += [(row[i], w, column[i]) for i in inside[_best(row[inside], value[inside], self.negatives)]]
            if not out:
                return None
            r, w, c = (np.array(part) for part in zip(*out))
            of = lambda name: [v[j] for v, j in zip(piece.column(name).take(pa.array(r)).to_pylist(), w)]
            slot, anchor = (piece.column(name).take(pa.array(r)) for name in ("slot", "id"))
            columns = [slot, anchor, pa.array(w, pa.int32()), pa.array(of("positive_ids"), pa.int64()), pa.array(of("positive_scores"), pa.int64()), pa.array(ids[c]), pa.array(s[r, c])]
            return pa.RecordBatch.from_arrays(columns, names)

        return self._meet(batches, answer)


def _ranges(tree: Tree, dim: int):
    """One row a task and pair (split point, subtree) of a node: the ranges over the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, counts = [Node(n.points, n.children) for n in tree.nodes], [np.zeros(len(n.points), np.int64) for n in tree.nodes]
        for batch in batches:
            x = unpack(batch.column("v"), dim).astype(float)

            def seen(at: int, rows: np.ndarray, apart: np.ndarray, nearest: np.ndarray, x=x) -> None:
                mine[at].widen(x[rows], apart, nearest)
                counts[at] += np.bincount(nearest, minlength=len(counts[at]))

            tree.leaf_of(x, seen)
        rows = [
            (at, i, int(j), n.near[i, j], n.far[i, j], n.shortest[j], n.longest[j], int(c[j]))
            for at, (n, c) in enumerate(zip(mine, counts))
            for j in np.flatnonzero(c)
            for i in range(len(n.points))
        ]
        if rows:
            types = [pa.int32()] * 3 + [pa.float64()] * 4 + [pa.int64()]
            names = ["node", "i", "j", "near", "far", "shortest", "longest", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _plant(rows: DataFrame, n: int, dim: int, **asked: int) -> _Search:
    """The tree over all rows. The driver holds the sample, the split points and their ranges, all bounded."""
    most = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, dim))))
    some = rows.where(F.pmod(F.xxhash64("slot"), F.lit(max(1, n))) < most).select("id", "label", "v").limit(2 * most).toArrow()
    sample = np.concatenate([unpack(c, dim) for c in some.column("v").chunks] or [np.zeros((0, dim), np.int64)])
    if not len(sample):
        first = rows.select("id", "label", "v").limit(1).toArrow()
        some, sample = first, np.concatenate([unpack(c, dim) for c in first.column("v").chunks])
    tree = Tree(sample.astype(float), n)
    found = rows.select("v").mapInArrow(_ranges(tree, dim), "node int, i int, j int, near double, far double, shortest double, longest double, n long")
    found = found.groupBy("node", "i", "j").agg(F.min("near"), F.max("far"), F.min("shortest"), F.max("longest"), F.sum("n"))
    sizes = np.zeros(tree.leaves, np.int64)
    for at, i, j, near, far, shortest, longest, count in found.collect():
        node = tree.nodes[at]
        node.near[i, j], node.far[i, j], node.shortest[j], node.longest[j] = near, far, shortest, longest
        if node.children[j] < 0:
            sizes[~node.children[j]] = count
    block = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    ids, labels = (np.asarray(some.column(c).combine_chunks()) for c in ("id", "label"))
    return _Search(tree, np.maximum(1, -(-sizes // block)), dim, sample, ids, labels, **asked)


ROW = "place long, id long, label long, v binary"
ASK = "place long, slot long, id long, label long, v binary"


def _met(rows: DataFrame, asks: DataFrame, answer, kind: str) -> DataFrame:
    """Blocks and the anchors sent to them, each block in front of its anchors in one task's stream."""
    extra = [c for c in asks.columns if c not in rows.columns]
    blank = [F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in extra]
    both = rows.select("*", *blank, F.lit(False).alias("asks")).unionByName(asks.withColumn("asks", F.lit(True)))
    return both.repartition("place").sortWithinPartitions("place", "asks").mapInArrow(answer, kind)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A vector's components are taken as floor(256 * x); a row's score is its exact integer inner
    product with the anchor, higher first, ties by smaller id. An anchor's positives are its
    first `positives` other rows of its label. For each of them the first `negatives` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score
    are returned, ranked from 1. `anchors` is a condition on the columns of `vectors`.

    Rows with a null id, label or vector, or with a null or non-finite component take no part;
    rows with the anchor's own id are not others. Repeated rows count as often as they are
    there, and a repeated anchor is answered as often. Of vectors of different lengths the
    shorter ones count as followed by zeros; components beyond 2 ** 53 after scaling count as
    that, scores beyond a long as its ends. A positive score under zero has no window. No
    anchors or no rows give no rows; other columns are not read.

    A sample of bounded size plants a tree of split points (GNAT). Every row belongs to its
    nearest split point's subtree; over all rows each split point knows the range of its
    distances to each sibling subtree. A window of scores is an annulus of distances around
    the anchor, the open end closed by what the sample holds already, and subtrees whose
    range can't meet it are not visited. Leaves are scanned exactly, in blocks of bounded
    size, so a leaf that holds most rows (one vector repeated) is many tasks' work. The
    result does not depend on the sample.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = given.where("id is not null and label is not null and v is not null").mapInArrow(_quantised, "id long, label long, anchor boolean, dim int, v binary")
    counted = Observation()
    rows = materialise(rows.withColumn("slot", F.monotonically_increasing_id()).observe(counted, F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")))
    n, dim = counted.get["n"], counted.get["dim"]
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], kind)
    search = _plant(rows, n, dim, positives=positives, negatives=negatives, low=low, high=high)
    blocks = rows.select("slot", "id", "label", "v").mapInArrow(search.rows, ROW)
    asking = rows.where("anchor").select("slot", "id", "label", "v")
    found = _met(blocks, asking.mapInArrow(search.ask_positives, f"{ASK}, least long"), search.positives_of, "slot long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("positive_score"), "positive_id"))
    first = found.withColumn("nth", nth).where(F.col("nth") <= positives)
    first = first.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))
    first = first.select("slot", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    asking = materialise(asking.join(first, "slot"))
    more = "positive_ids array<long>, positive_scores array<long>, least array<long>, most array<long>"
    mined = _met(
        blocks,
        asking.mapInArrow(search.ask_negatives, f"{ASK}, {more}"),
        search.negatives_of,
        "slot long, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    rank = F.row_number().over(Window.partitionBy("slot", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    return mined.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
