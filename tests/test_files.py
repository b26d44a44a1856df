from pathlib import Path

from pyspark.sql import functions as F

from kbspark.sources import files


def test_sources_with_sidecars(spark, tmp_path):
    rows = [("a1", "text \\ \"one\"\n", 'https://x.org/?q="a"\\b', "job\n1", 3), ("b2", "x", None, "j", None), ("c3", "tail", "u", "é ", 5)]
    df = spark.createDataFrame(rows, "digest string, data string, url string, job string, arrival long").withColumn("fetched", F.lit(None).cast("string"))
    assert files.store_files(df, str(tmp_path / "s")) == 6
    (tmp_path / "s" / "b2.toml").write_text('url = "fine"\nno value here\n')
    (tmp_path / "s" / "d4").write_bytes(b"\xff\xfe raw")  # no sidecar at all
    got = {r.digest: r for r in files.scan_sources(spark, str(tmp_path / "s")).collect()}
    assert {d: bytes(r.content) for d, r in got.items()} == {"a1": rows[0][1].encode(), "b2": b"x", "c3": b"tail", "d4": b"\xff\xfe raw"}
    assert got["a1"].provenance == {"url": rows[0][2], "job": "job\n1", "arrival": "3"} and got["c3"].provenance["job"] == "é "
    assert got["b2"].provenance is None and got["d4"].provenance is None and {r.fault for r in got.values()} == {None}


def test_pages_that_can_not_be_read_are_rows(spark, tmp_path):
    path = tmp_path / "pages"
    spark.createDataFrame([("keep",), ("lost",)], "name string").withColumn("t", F.lit("some text\n" * 100)).repartition(2, "name").write.partitionBy("name").text(str(path / "sub"))
    for part in (path / "sub").glob("name=*/part-*.txt"):
        name = part.parent.name[5:]
        crc = part.parent / f".{part.name}.crc"
        part.rename(path / f"{name}.md")
        crc.rename(path / f".{name}.md.crc")
    broken = Path(path / "lost.md")
    broken.write_bytes(broken.read_bytes().replace(b"text", b"TEXT"))  # the bytes no longer fit their checksum
    (path / "bad.md").write_bytes(b"ok \xe2\x82 \xf0\x9f end \xff")
    (path / "big.md").write_bytes(b"x" * 5000)
    (path / "other.txt").write_bytes(b"no page")
    got = {r.name: (r.text, r.fault) for r in files.scan_pages(spark, str(path), cap=4000).collect()}
    assert got.keys() == {"keep.md", "lost.md", "bad.md", "big.md"}
    assert got["lost.md"] == (None, "unreadable") and got["big.md"] == (None, "too large") and got["keep.md"][1] is None
    assert got["bad.md"] == (b"ok \xe2\x82 \xf0\x9f end \xff".decode(errors="replace"), None)


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    """Folders are listed and files read by tasks; a file of no bytes is a file too."""
    path = str(tmp_path / "s")
    rows = spark.range(300).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("name"), F.when(F.col("id") > 0, F.col("id").cast("string").cast("binary")).alias("data"))
    assert files.write_files(rows, path, files.FAN) == 300
    assert all(p.name.startswith(p.parent.name) and len(p.parent.name) == files.FAN for p in (tmp_path / "s").rglob("*") if p.is_file())
    monkeypatch.setattr(files, "READ_FILES", 50)
    found = files.scan_files(spark, path)
    assert found.inputFiles() == [] or not any(f.startswith(f"file://{path}") for f in found.inputFiles())
    assert found.rdd.getNumPartitions() >= 6
    assert {r.name: bytes(r.content) for r in found.collect()} == {r.name: bytes(r.data or b"") for r in rows.collect()}
