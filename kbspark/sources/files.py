"""Raw files: content-addressed sources with sidecars, and page files, written by tasks and scanned in bulk."""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import materialise

SIDECAR = ".toml"
FILE_CAP = 1 << 30
PROVENANCE = ["url", "fetched", "content_type", "job", "arrival"]
# Stored sources lie in folders by the first digits of their digest, so that no folder is long to list.
FAN = 3
# A task reads about so many bytes, and so many files at most.
READ_BYTES, READ_FILES = 64 << 20, 8192
BATCH_BYTES = 8 << 20


def _system(path: str):
    """The file system of a path that all executors share, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(path)
        made = set()
        for batch in batches:
            names = batch.column("name").to_pylist()
            for folder, name, data in zip(batch.column("folder").to_pylist(), names, batch.column("data").to_pylist()):
                at = f"{root}/{folder}" if folder else root
                if at not in made:
                    system.create_dir(at, recursive=True)
                    made.add(at)
                # A task that runs twice writes the same file twice; readers never see half of one.
                with system.open_output_stream(f"{at}/.{name}.part") as out:
                    out.write(data or b"")
                system.move(f"{at}/.{name}.part", f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return run


def write_files(rows: DataFrame, path: str, fan: int = 0) -> int:
    """One file for each row (name, data binary) below path, a folder that all executors share; how many were written.

    Rows are written where they are, without a shuffle. Of rows of one name one stays. With fan,
    files lie in folders by the first characters of their names.
    """
    return rows.select(F.substring("name", 1, fan).alias("folder"), "name", "data").mapInArrow(_writer(path), "name string").count()


def sidecar(columns: dict[str, Column]) -> Column:
    """Provenance as lines key = "value"; unknown values are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{key} = "), _quoted(c))) for key, c in columns.items()]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))


def _quoted(c: Column) -> Column:
    """A JSON string, which is a TOML basic string too."""
    whole = F.to_json(F.struct(c.cast("string").alias("v")))  # {"v":"..."}
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def store_files(sources: DataFrame, path: str, fan: int = 0) -> int:
    """Sources (digest, data and provenance) as files named by digest, a sidecar beside each."""
    data = sources.select(F.col("digest").alias("name"), F.col("data").cast("binary").alias("data"))
    notes = sources.select(F.concat("digest", F.lit(SIDECAR)).alias("name"), sidecar({c: F.col(c) for c in PROVENANCE if c in sources.columns}).cast("binary").alias("data"))
    return write_files(data.unionByName(notes), path, fan)


LISTED = "path string, name string, size long, folder boolean, checked boolean"


def _lister(root: str, deep: bool):
    """What lies in each folder, or below it; as in Spark's own scans, names that begin with a dot or underscore are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = _system(root)
        for batch in batches:
            todo = [p or top for p in batch.column("path").to_pylist()]
            while todo:
                found = system.get_file_info(fs.FileSelector(todo.pop()))
                sums = {i.base_name for i in found if i.base_name.endswith(".crc")}
                found = [i for i in found if not i.base_name.startswith((".", "_"))]
                is_folder = [i.type == fs.FileType.Directory for i in found]
                if deep:
                    todo += [i.path for i, f in zip(found, is_folder) if f]
                columns = [[i.path for i in found], [i.base_name for i in found], [i.size or 0 for i in found], is_folder, [f".{i.base_name}.crc" in sums for i in found]]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in LISTED.split(", ")])

    return run


def _intact(data: bytes, sums: bytes) -> bool:
    """Whether data fits the checksums that Hadoop's local file system laid beside it: a CRC-32 for each so many bytes."""
    each = struct.unpack(">i", sums[4:8])[0]
    return sums[8:] == b"".join(struct.pack(">I", zlib.crc32(data[at : at + each])) for at in range(0, len(data), each))


def _reader(root: str, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(root)

        def read(path: str, name: str, size: int, checked: bool) -> tuple[bytes | None, str | None]:
            if size > cap:
                return None, "too large"
            try:
                with system.open_input_stream(path) as f:
                    data = f.read()
                if checked:
                    with system.open_input_stream(f"{path.removesuffix(name)}.{name}.crc") as f:
                        if not _intact(data, f.read()):
                            return None, "unreadable"
                return data, None
            except OSError:
                return None, "unreadable"

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["name", "size", "content", "fault"])

        rows, held = [], 0
        for batch in batches:
            for path, name, size, checked in zip(*[batch.column(c).to_pylist() for c in ("path", "name", "size", "checked")]):
                data, fault = read(path, name, size, checked)
                rows.append((name, size, data, fault))
                held += len(data or b"") + 200
                if held >= BATCH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return run


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size, folder, checked) of every file below path that the glob takes, listed by tasks: the driver holds no path.

    One task lists path itself, others the folders in it, each with all that is below.
    """
    top = materialise(spark.range(1).select(F.lit(None).cast("string").alias("path")).mapInArrow(_lister(path, False), LISTED))
    folders = top.where("folder").select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    found = top.unionByName(folders.mapInArrow(_lister(path, True), LISTED)).where("not folder")
    matches = fnmatch.translate(glob).replace(r"\Z", r"\z")
    return materialise(found if glob == "*" else found.where(F.col("name").rlike(r"\A" + matches)))


def read_files(listed: DataFrame, path: str, cap: int = FILE_CAP) -> DataFrame:
    """(name, size, content, fault) of listed files, each read where its path was dealt to."""
    whole = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    parts = max(listed.sparkSession.sparkContext.defaultParallelism, -(-whole["bytes"] // READ_BYTES), -(-whole["n"] // READ_FILES))
    return listed.repartition(parts, "path").mapInArrow(_reader(path, cap), "name string, size long, content binary, fault string")


def scan_files(spark: SparkSession, path: str, glob: str = "*", cap: int = FILE_CAP) -> DataFrame:
    """(name, size, content, fault): every file below path that the glob takes.

    A file larger than cap is not read: `too large`. One that can't be read, or whose bytes do
    not fit the checksums beside it, is `unreadable`; it stops nothing. Names are the last part
    of the path. Paths are listed, dealt out and read by tasks; contents are not shuffled.
    """
    return read_files(list_files(spark, path, glob), path, cap)


def scan_pages(spark: SparkSession, path: str, glob: str = "*.md", cap: int = FILE_CAP) -> DataFrame:
    """(name, text, fault) of page files; invalid byte sequences are replaced."""
    return scan_files(spark, path, glob, cap).select("name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "fault")


def parse_sidecar(text: Column) -> Column:
    """The map of a sidecar, or null if any line is not key = "value"."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    value = lambda x: F.from_json(F.concat(F.lit('{"v":'), F.regexp_replace(x, r"\A[^=]*=", ""), F.lit("}")), "v string")["v"]
    good = lambda x: x.rlike(r'\A[A-Za-z0-9_-]+ *= *"([^"\\]|\\.)*" *\z') & value(x).isNotNull()
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), value(x)))
    return F.when(F.forall(lines, good), F.map_from_entries(pairs))


def scan_sources(spark: SparkSession, path: str, cap: int = FILE_CAP) -> DataFrame:
    """(digest, size, content, provenance map, fault): every source file, its sidecar parsed beside it.

    The stem is the digest. A source without sidecar, or with one that doesn't parse, has no
    provenance and is a source all the same; a file that can't be read has its fault.
    """
    listed = list_files(spark, path)
    is_note = F.col("name").endswith(SIDECAR)
    notes = read_files(listed.where(is_note), path, cap).select(F.expr(f"left(name, length(name) - {len(SIDECAR)})").alias("of"), parse_sidecar(F.make_valid_utf8(F.col("content").cast("string"))).alias("provenance"))
    found = read_files(listed.where(~is_note), path, cap).withColumn("digest", F.substring_index("name", ".", 1))
    return found.join(notes, F.col("name") == F.col("of"), "left").select("digest", "size", "content", "provenance", "fault")
