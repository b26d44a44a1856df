"""Media columns: sniff signatures in stored bytes, validate structure, correct types, carve."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (magic bytes, place of the magic from the start of the media, type).
SIGNATURES = [
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"%PDF-", 0, "application/pdf"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
]
SAMPLE_RATE = 8000


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, place, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic) + place, kind))
    found.make_automaton()
    return found


# Bounds on what one signature may cost; what lies beyond them is not carved.
MOST_CHUNKS = 128  # of a RIFF file
FAR_MARKS = 64  # end marks of a PDF behind another PDF's header that are looked at, from either end
MOST_NAME = 4096  # bytes of a name inside a gzip header
MOST_DEPTH = 8  # media inside media inside media
_ENDMARK = re.compile(rb"startxref\s+([0-9]{1,15})\s+%%EOF")
_XREF = re.compile(rb"xref\b|[0-9]{1,10}\s{1,10}[0-9]{1,10}\s{1,10}obj\b")
_STEP = 1 << 14


def _squared(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


def _times(m: list[int], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= m[i]
        x, i = x >> 1, i + 1
    return out


@lru_cache(maxsize=1)
def _zero_bytes() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes do to a CRC-32, as matrices over its bits."""
    m = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        m = _squared(m)
    out = [m]
    while len(out) < 32:
        out.append(_squared(out[-1]))
    return out


class _Bytes:
    """Stored bytes with what validators have learned of them.

    Each validator takes where a media starts and the end it must keep to, and gives its own
    end, or 0. Walks from different starts that come to the same place share the rest of the
    way, and end marks are found once, so that many signatures cost no more than few.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.n = data, len(data)
        self.memo: dict[tuple, int] = {}

    @cached_property
    def _pdf_marks(self) -> tuple[list[int], list[int], list[int]]:
        """Starts, ends and said places of the marks that end a save."""
        found = [(m.start(), m.end(), int(m[1])) for m in _ENDMARK.finditer(self.data)]
        return [m[0] for m in found], [m[1] for m in found], [m[2] for m in found]

    @cached_property
    def _pdf_heads(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-", self.data)]

    @cached_property
    def zip_ends(self) -> dict[int, list[tuple[int, int]]]:
        """By the start that an end record says: where its directory stands (none: -1), and the archive's end."""
        out: dict[int, list[tuple[int, int]]] = {}
        for m in re.finditer(rb"PK\x05\x06", self.data):
            if m.start() + 22 <= self.n:
                size, start, note = struct.unpack_from("<IIH", self.data, m.start() + 12)
                out.setdefault(m.start() - size - start, []).append((m.start() - size if size else -1, m.start() + 22 + note))
        return out

    @cached_property
    def _jpeg_markers(self) -> np.ndarray:
        """Places of FF that is neither stuffed nor a restart."""
        b = np.frombuffer(self.data, np.uint8)
        at = np.flatnonzero(b[:-1] == 0xFF) if len(b) else np.empty(0, int)
        follow = b[at + 1]
        return at[(follow != 0) & ~((follow >= 0xD0) & (follow <= 0xD7))]

    @cached_property
    def _crc_before(self) -> list[int]:
        out = [0]
        for at in range(0, self.n, _STEP):
            out.append(zlib.crc32(self.data[at : at + _STEP], out[-1]))
        return out

    def _crc(self, start: int, end: int) -> int:
        if end - start <= 2 * _STEP:
            return zlib.crc32(self.data[start:end])
        # From the checksums of all that comes before either end.
        front, whole = (zlib.crc32(self.data[at // _STEP * _STEP : at], self._crc_before[at // _STEP]) for at in (start, end))
        size, k = end - start, 0
        while size:
            if size & 1:
                front = _times(_zero_bytes()[k], front)
            size, k = size >> 1, k + 1
        return front ^ whole

    def _walk(self, kind: str, at: int, step: Callable[[int], tuple[bool, int]]) -> int:
        """Where a chain of steps (done, place) ends; every place on the way is remembered with it."""
        path = []
        while (out := self.memo.get((kind, at))) is None:
            path.append(at)
            done, at = step(at)
            if done:
                out = at
                break
        for place in path:
            self.memo[kind, place] = out
        return out

    def wav(self, start: int, limit: int) -> int:
        b = self.data
        if limit - start < 12 or b[start + 8 : start + 12] != b"WAVE":
            return 0
        end, at, seen = start + 8 + struct.unpack_from("<I", b, start + 4)[0], start + 12, set()
        if end > limit:
            return 0
        for _ in range(MOST_CHUNKS):
            if at + 8 > end:
                break
            size = struct.unpack_from("<I", b, at + 4)[0]
            seen.add(b[at : at + 4])
            at += 8 + size + (size & 1)
        return end if at in (end, end + 1) and {b"fmt ", b"data"} <= seen else 0

    def png(self, start: int, limit: int) -> int:
        b = self.data

        def step(at: int) -> tuple[bool, int]:
            if at + 12 > self.n:
                return True, 0
            size, kind = struct.unpack_from(">I", b, at)[0], b[at + 4 : at + 8]
            if at + 12 + size > self.n or not kind.isalpha() or self._crc(at + 4, at + 8 + size) != struct.unpack_from(">I", b, at + 8 + size)[0]:
                return True, 0
            return kind == b"IEND", at + 12 + size

        first = b[start + 8 : start + 16]
        return self._walk("png", start + 8, step) if first == b"\0\0\0\x0dIHDR" else 0

    def gif(self, start: int, limit: int) -> int:
        b = self.data
        if limit - start < 14:
            return 0

        def block(at: int) -> tuple[bool, int]:
            return (True, at + 1) if at >= self.n or not b[at] else (False, at + 1 + b[at])

        def step(at: int) -> tuple[bool, int]:
            if at >= self.n:
                return True, 0
            if b[at] == 0x3B:
                return True, at + 1
            if b[at] == 0x21:
                return False, self._walk("gif block", at + 2, block)
            if b[at] == 0x2C and at + 10 <= self.n:
                return False, self._walk("gif block", at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0), block)
            return True, 0

        return self._walk("gif", start + 13 + (3 << (b[start + 10] & 7) + 1 if b[start + 10] & 0x80 else 0), step)

    def jpeg(self, start: int, limit: int) -> int:
        b = self.data

        def step(at: int, scans: bool) -> tuple[bool, int]:
            if scans and b[at : at + 2] == b"\xff\xd9":
                return True, at + 2
            if at + 4 > self.n or b[at] != 0xFF or b[at + 1] == 0xD9:
                return True, 0
            to = at + 2 + struct.unpack_from(">H", b, at + 2)[0]
            if b[at + 1] != 0xDA:
                return False, to
            k = int(np.searchsorted(self._jpeg_markers, to))
            return (True, 0) if k == len(self._jpeg_markers) else (False, int(self._jpeg_markers[k]))

        def before(at: int) -> tuple[bool, int]:
            if at + 4 <= self.n and b[at] == 0xFF and b[at + 1] == 0xDA:
                done, to = step(at, False)
                return True, 0 if done else self._walk("jpeg scans", to, lambda p: step(p, True))
            return step(at, False)

        return self._walk("jpeg", start + 2, before)

    def bmp(self, start: int, limit: int) -> int:
        if limit - start < 26:
            return 0
        size, _, pixels, header = struct.unpack_from("<IIII", self.data, start + 2)
        return start + size if header in (12, 40, 108, 124) and 14 + header <= pixels <= size <= limit - start else 0

    def zip(self, start: int, limit: int) -> int:
        # Stored archives have end records of their own; the right one counts from this start.
        for directory, end in self.zip_ends.get(start, ()):
            if end <= limit and (directory < 0 or self.data[directory : directory + 4] == b"PK\x01\x02"):
                return end
        return 0

    def pdf(self, start: int, limit: int) -> int:
        # Each save adds a section that ends in the place of its cross-references, from this file's start.
        starts, ends, places = self._pdf_marks
        k = bisect_right(self._pdf_heads, start)
        header = min(self._pdf_heads[k], limit) if k < len(self._pdf_heads) else limit
        first, until = bisect_left(starts, start), bisect_right(ends, limit)
        if first >= until:
            return 0
        own = min(until, max(first, bisect_right(ends, header)))
        # Behind another file's header only a place behind it too is this file's own.
        far = range(own, until) if until - own <= 2 * FAR_MARKS else [*range(own, own + FAR_MARKS), *range(until - FAR_MARKS, until)]
        for i in reversed(far):
            if header < start + places[i] < limit and _XREF.match(self.data, start + places[i]):
                return ends[i]
        for i in range(own - 1, first - 1, -1):
            if _XREF.match(self.data, min(start + places[i], limit)):
                return ends[i]
        # Where no place holds: the last end before another file's header, or else the first one.
        return ends[own - 1] if own > first else ends[first]

    def gzip(self, start: int, limit: int) -> int:
        b, at = self.data, start + 10
        if limit - start < 18 or (flags := b[start + 3]) & 0xE0:
            return 0
        if flags & 4:
            at += 2 + int.from_bytes(b[at : at + 2], "little")
        for bit in (8, 16):  # a name and a comment, each to its zero byte
            if flags & bit and (at := b.find(b"\0", at, min(limit, at + MOST_NAME)) + 1) == 0:
                return 0
        d, view = zlib.decompressobj(31), memoryview(b)
        try:
            for at in range(start, limit, _STEP):
                rest = view[at : min(limit, at + _STEP)]
                while rest and not d.eof:
                    d.decompress(rest, 1 << 16)
                    rest = d.unconsumed_tail
                if d.eof:
                    return min(limit, at + _STEP) - len(d.unused_data)
        except zlib.error:
            pass
        return 0

    def flac(self, start: int, limit: int) -> int:
        b, at = self.data, start + 4
        if b[at : at + 4] not in (b"\0\0\0\x22", b"\x80\0\0\x22"):
            return 0

        def step(at: int) -> tuple[bool, int]:
            if at + 4 > self.n:
                return True, 0
            to = at + 4 + int.from_bytes(b[at + 1 : at + 4], "big")
            return (True, 0) if to > self.n else (b[at] >> 7 == 1, to)

        # Frames have no length of their own; they run to the end.
        return limit if 0 < self._walk("flac", at, step) <= limit else 0

    def ogg(self, start: int, limit: int) -> int:
        b = self.data

        def step(at: int) -> tuple[bool, int]:
            if at + 27 > self.n or b[at : at + 4] != b"OggS" or b[at + 4] != 0:
                return True, 0
            to = at + 27 + b[at + 26] + sum(b[at + 27 : at + 27 + b[at + 26]])
            return (True, 0) if to > self.n else (b[at + 5] & 4 != 0, to)

        return self._walk("ogg", start, step)


VALIDATORS = {
    "audio/wav": _Bytes.wav, "image/png": _Bytes.png, "image/gif": _Bytes.gif, "image/jpeg": _Bytes.jpeg, "image/bmp": _Bytes.bmp, "application/zip": _Bytes.zip,
    "application/pdf": _Bytes.pdf, "application/gzip": _Bytes.gzip, "audio/flac": _Bytes.flac, "audio/ogg": _Bytes.ogg,
}
# Members of an archive and pages of a stream have its signature; they are no media of their own.
STREAMS = ("audio/ogg", "audio/flac")


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every media in data whose structure and length hold, by offset; those inside others too."""
    found, around, stored = [], [], _Bytes(data)
    for end, (back, kind) in _automaton().iter(data.decode("latin-1")):
        at = end + 1 - back
        if at < 0:
            continue
        while around and around[-1][1] <= at:
            around.pop()
        if len(around) >= MOST_DEPTH or (kind in STREAMS and around and around[-1][0] == kind):
            continue
        # What lies inside another media ends there at the latest.
        limit = around[-1][1] if around else len(data)
        to = VALIDATORS[kind](stored, at, limit)
        if at < to <= limit:
            found.append((kind, at, to - at))
            around.append((kind, to))
    return found


def wav_payload(data: bytes) -> bytes:
    """The samples of a valid WAV file."""
    at = 12
    while data[at : at + 4] != b"data":
        size = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + size + (size & 1)
    return data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]


SPAN = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        declared = batch.column("declared").to_pylist()
        types, fixed, spans = [], [], []
        for data, said in zip(batch.column("data").to_pylist(), declared):
            data = data or b""
            found = sniff(data)
            # Media that starts the bytes is their type; with none, what was declared stays unless it claims one of ours.
            own = found[0][0] if found and found[0][1] == 0 else ("application/octet-stream" if said in VALIDATORS else said)
            types.append(own)
            fixed.append(own != said)
            spans.append([{"type": k, "offset": a, "length": n, "sha256": hashlib.sha256(data[a : a + n]).hexdigest()} for k, a, n in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("data"), pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(spans, pa.list_(SPAN))],
            ["id", "data", "type", "corrected", "carved"],
        )


def sniff_media(media: DataFrame, id_col: str = "id", data_col: str = "data", declared_col: str = "declared") -> DataFrame:
    """One row per input row: id, data, type, corrected, carved array<type, offset, length, sha256>.

    One automaton pass over the bytes finds the magic bytes of all formats, and a format's
    validator walks its structure (chunks, checksums, lengths) before a span counts. Spans
    inside valid ones are carved too and follow them. type is that of the media at offset 0; without one a
    declared type of a known format becomes application/octet-stream and any other declared
    type stays. Null or empty bytes have no spans. Repeated rows are all returned, no rows give
    no rows, other columns are not read. A map over the rows: no shuffle.
    """
    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"), F.col(declared_col).alias("declared"))
    schema = f"id {kind}, data binary, type string, corrected boolean, carved array<struct<type:string,offset:long,length:long,sha256:string>>"
    return rows.mapInArrow(_sniffed, schema)


# How a text is stored, by its digest: the media's type, whether an archive holds it, and what is declared of it.
STORED = ("audio/wav", "image/png", "image/bmp")
DECLARED = ("audio/wav", "image/png", "image/jpeg", "application/octet-stream", "application/zip")


def _as_wav(payload: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", len(payload) + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def _as_png(payload: bytes) -> bytes:
    """8-bit grey, 64 samples a line."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    lines = np.zeros((len(rows), 65), np.uint8)
    lines[:, 1:] = rows
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 1)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def _as_bmp(payload: bytes) -> bytes:
    """8 bits a sample with a grey palette, 64 samples a line, first line first."""
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", start + len(payload), 0, start, 40, 64, -(len(payload) // 64), 1, 8, 0, len(payload), 0, 0, 256, 0) + palette + payload


def _from_wav(data: bytes) -> bytes:
    return wav_payload(data)


def _from_png(data: bytes) -> bytes:
    at, packed = 8, []
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0]
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, 65)[:, 1:].tobytes()


def _from_bmp(data: bytes) -> bytes:
    return data[struct.unpack_from("<I", data, 10)[0] :]


WRITE = dict(zip(STORED, (_as_wav, _as_png, _as_bmp)))
READ = dict(zip(STORED, (_from_wav, _from_png, _from_bmp)))


def _archived(media: bytes) -> bytes:
    """A ZIP archive that stores the media as its only member, the same for the same media."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo("media"), media)
    return out.getvalue()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's UTF-8 bytes, padded by 0 to a positive multiple of 64, as media with a declared type."""
    for batch in batches:
        sizes, out, said = [], [], []
        for text in batch.column("body").to_pylist():
            raw = (text or "").encode()
            mark = zlib.crc32(raw)
            media = WRITE[STORED[mark % 3]](raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))
            sizes.append(len(raw))
            out.append(_archived(media) if mark // 3 % 4 == 0 else media)
            said.append(DECLARED[mark // 12 % 5])
        key = pa.StructArray.from_arrays([batch.column("id"), pa.array(sizes, pa.int64())], ["id", "n_bytes"])
        yield pa.RecordBatch.from_arrays([key, pa.array(out, pa.binary()), pa.array(said, pa.string())], ["id", "data", "declared"])


def _features(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    ups = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"samples={len(x)} sum={int(x.sum(dtype=np.int64))} peak={int(x.max())} low={int(x.min())} crossings={ups}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, n, data, own, fixed, carved in zip(*(batch.column(c).to_pylist() for c in ("id", "n_bytes", "data", "type", "corrected", "carved"))):
            # The media is carved from its archive, if it is in one.
            at = 1 if own == "application/zip" else 0
            span, inner = carved[at], carved[at + 1 :]
            media = data[span["offset"] : span["offset"] + span["length"]]
            payload = READ[span["type"]](media)
            marks = zlib.crc32("".join(x["sha256"] for x in inner).encode())
            feature = f"type={own} corrected={str(fixed).lower()} media={span['type']} {_features(payload)} embedded={len(inner)} carved={marks:08x}"
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), span["sha256"], feature))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, sniff the stored bytes, carve the media, read its samples back and digest them.

    By its digest a text becomes a WAV, a PNG or a BMP of 8-bit samples, one in four inside an
    archive, with a declared type that is mostly wrong: sniffing finds the true type, and what
    is read back is what it carves. feature names the type found, whether it was declared
    wrongly, and what lies inside the media. Null text is empty, which stores 64 zero samples;
    equal texts give equal values, repeated rows are all returned, no rows give no rows. A map
    over the rows; id_col, which becomes doc_id, and text_col are all that is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    stored = rows.mapInArrow(_stored, f"id struct<id:{kind},n_bytes:long>, data binary, declared string")
    found = sniff_media(stored).select("id.id", "id.n_bytes", "data", "type", "corrected", "carved")
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return found.mapInArrow(_digests, schema)
