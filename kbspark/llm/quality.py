"""Quality classifier: zstandard dictionaries of good and bad text, calibrated size differences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.session import materialise

LEVEL = 3
DICT_BYTES = 112_640
# Labelled rows fetched at most, for each label: so many for its dictionary and so many to calibrate.
DICT_ROWS = 1500
FIT_ROWS = 2500
# And bytes fetched at most for each label; a text that does not fit, or is larger than its share, is passed over alone.
FIT_BYTES, SHARE = 32 << 20, 64
BLANKS = re.compile("[^\x20\x09-\x0d]+")


class _Outline(dict):
    """Characters by their kind: letters as a or A, digits as 0, other ASCII as it is."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if code < 128 else "~"
        return self.setdefault(code, kind)


_outline = _Outline()


def _repeats(text: str) -> bytes:
    """A letter for each word: n if it is new, else how far back it was last, by powers of two."""
    last: dict[str, int] = {}
    out = bytearray()
    for i, word in enumerate(BLANKS.findall(text)):
        out.append(ord("n") if word not in last else 48 + min(20, (i - last[word]).bit_length()))
        last[word] = i
    return bytes(out)


# What is compressed: the text, the kinds of its characters, and how its words repeat.
VIEWS = (str.encode, lambda text: text.translate(_outline).encode(), _repeats)


@dataclass(frozen=True)
class Model:
    """For each view a dictionary of good and one of bad text; the calibration of the size differences."""

    dictionaries: tuple[tuple[bytes, bytes], ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Too few or too like one another for a trained one: what fits of the samples' end.
        return b"\n".join(texts)[-DICT_BYTES:]


def _compressor(data: bytes):
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(data, dict_type=kind)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _tools(model_dictionaries) -> list[tuple]:
    return [tuple(_compressor(d) for d in pair) for pair in model_dictionaries]


def differences(tools: list[tuple], texts: list[str]) -> np.ndarray:
    """For every text and view the difference of its compressed sizes, by length and by size."""
    rows = []
    for text in texts:
        row = []
        for view, (good, bad) in zip(VIEWS, tools):
            raw = view(text)
            g, b = len(good.compress(raw)), len(bad.compress(raw))
            row += [(b - g) / (len(raw) + 1), (b - g) / max(g, b)]
        rows.append(row)
    return np.array(rows, float).reshape(-1, 2 * len(VIEWS))


def features(tools: list[tuple], texts: list[str]) -> np.ndarray:
    """The size differences, the same by the log of the length, their squares, and products across views.

    Length tells how far a difference is to be trusted; nothing here is other than zero where
    the differences are zero.
    """
    d = differences(tools, texts)
    size = np.log([len(t) + 1 for t in texts]).reshape(-1, 1)
    by_length = d[:, ::2]
    across = [by_length[:, i] * by_length[:, j] for i in range(len(VIEWS)) for j in range(i)]
    return np.c_[d, d * size, d * d, *across]


def _logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method on the log loss, rows weighed by mass, with a ridge on all weights but the first."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), ridge * mass.sum() * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (mass * p * (1 - p) + 1e-6)) @ x + np.diag(penalty + 1e-9), x.T @ (mass * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit(rows: list[tuple[str, int, int]], counts: dict[int, int]) -> Model:
    """rows: text, label, place in the label's order; counts: all rows by label.

    The first half of a label makes its dictionaries, the rest calibrates, each label with the weight that it has among all rows.
    """
    by_label = {k: [t for t, label, _ in sorted(rows, key=lambda r: r[2]) if label == k] for k in (0, 1)}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    prior = (n_good + 1) / (n_good + n_bad + 2)
    cut = {k: min(DICT_ROWS, len(v) // 2) for k, v in by_label.items()}
    if min(cut.values()) < 1:
        return Model((), (), (), prior)
    dictionaries = tuple(tuple(_dictionary([view(t) for t in by_label[k][: cut[k]]]) for k in (1, 0)) for view in VIEWS)
    rest = [(t, k) for k, v in by_label.items() for t in v[cut[k] :]]
    x, y = features(_tools(dictionaries), [t for t, _ in rest]), np.array([k for _, k in rest], float)
    share = {k: counts[k] / max(1, len(by_label[k]) - cut[k]) for k in (0, 1)}
    mass = np.array([share[k] for _, k in rest])
    scale = x.std(0) + 1e-9
    return Model(dictionaries, tuple(scale), tuple(_logistic(x / scale, y, mass / mass.mean())), prior)


def _within(sizes: list[tuple[int, int]]) -> list[int]:
    """Places of the texts (place, bytes) that are fetched: in order, each that fits what is left and its share.

    Where fewer than two keep to the share, larger ones are taken too, as long as they fit.
    """
    for most in (FIT_BYTES // SHARE, FIT_BYTES):
        room, taken = FIT_BYTES, []
        for place, size in sorted(sizes):
            if size <= min(room, most):
                taken.append(place)
                room -= size
        if len(taken) > 1:
            break
    return taken


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded sample: of each label (0 and 1) the DICT_ROWS + FIT_ROWS rows whose ids hash lowest.

    At most 2 * (DICT_ROWS + FIT_ROWS) ids are broadcast, and of their texts the driver takes at
    most FIT_BYTES for each label; a text that does not fit, or is larger than FIT_BYTES / SHARE,
    is passed over alone, whatever comes behind it. Rows with another or no label are passed
    over; of repeated ids one row counts. Without two rows of each label the model gives
    everyone the smoothed share of label 1.
    """
    most = DICT_ROWS + FIT_ROWS
    order = [F.xxhash64("key"), F.col("key")]
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null")
    marked = marked.groupBy("key").agg(F.min("label").alias("label")).where("label in (0, 1)")
    counts = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Half of a label's rows, and no more than the dictionary's share, come first in its order.
    picked = None
    for label in (0, 1):
        part = marked.where(F.col("label") == label).orderBy(*order).limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.withColumn("place", F.xxhash64("key"))
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = texts.join(F.broadcast(picked), "key").groupBy("key").agg(F.min("body").alias("body"), F.first("label").alias("label"), F.first("place").alias("place"))
    rows = materialise(rows.select("body", "label", "place"))
    sizes = rows.select("label", "place", F.octet_length("body").alias("size")).collect()
    taken = [(k, place) for k in (0, 1) for place in _within([(r.place, r.size) for r in sizes if r.label == k])]
    chosen = docs.sparkSession.createDataFrame(taken, "label int, place long")
    return _fit([(r.body, r.label, r.place) for r in rows.join(F.broadcast(chosen), ["label", "place"]).collect()], counts)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(model.dictionaries)
        for batch in batches:
            texts = [t or "" for t in batch.column("body").to_pylist()]
            if tools and texts:
                x = features(tools, texts) / np.array(model.scale)
                score = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ np.array(model.weights), -30, 30)))
            else:
                score = np.full(len(texts), model.prior)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], ["row", "score"])

    return run


def _scored(docs: DataFrame, model: Model, columns: list[str], text_col: str) -> DataFrame:
    """row (a struct of the columns as c0, c1, ...) and score."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = docs.select(row.alias("row"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_scorer(model), f"row {rows.schema['row'].dataType.simpleString()}, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score in [0, 1] of every row, higher for likelier label 1.

    A text's whole bytes are compressed with a dictionary of good and one of bad text, and so
    are two views of it: the kinds of its characters, and how its words repeat. The normalised
    size differences, calibrated, are the score. Null and empty texts have a
    score like any other, equal texts equal scores, very long ones are compressed whole, no
    rows give no rows; other columns are not read. No shuffle.
    """
    return _scored(docs, model, [id_col], text_col).select(F.col("row.c0").alias(id_col), "score")


def keep_good(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns."""
    good = _scored(docs, model, docs.columns, text_col).where(F.col("score") >= least)
    return good.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
