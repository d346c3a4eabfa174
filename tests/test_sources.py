"""Files: strict JSON, checked CSV, byte evidence, images, publishing and listings."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tallyspark.sources import files


def png(width: int = 3, height: int = 2) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + b"\x10\x20\x30" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xda\x00\x02xx\xff\xd9"


def test_documents_skip_what_is_no_json(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "n": 2}, indent=1))
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "n": 1}))
    (tmp_path / "c.json").write_text("{not json")
    found = files.read_documents(spark, str(tmp_path), "id string, n int").orderBy("file_name").collect()
    assert [(r.id, r.n, r.file_name) for r in found] == [("a", 1, "a.json"), ("b", 2, "b.json")]


def test_lines_and_replaced_documents(spark, tmp_path):
    at = str(tmp_path / "out")
    for rows in ([(1, "x")], [(2, "y"), (3, "z")]):
        files.write_documents(spark.createDataFrame(rows, "n int, s string"), at)
    assert sorted(map(tuple, files.read_lines(spark, at, "n int, s string").collect())) == [(2, "y"), (3, "z")]
    (tmp_path / "bad.json").write_text('{"n": 1}\n\n{"n": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_lines(spark, str(tmp_path / "bad.json"), "n int").collect()


def test_csv_wants_its_header_and_width(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"two\nlines, ""quoted"""\n3,\n')
    found = files.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()
    assert [tuple(r) for r in found] == [("1", 'two\nlines, "quoted"'), ("3", None)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "t.csv"), ["b", "a"])
    (tmp_path / "w.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(tmp_path / "w.csv"), ["a", "b"]).collect()


def test_strict_json(spark):
    cases = [(b'{"a": [1, {"b": null}]}', None), (b'\xef\xbb\xbf{}', "bom"), (b'{"a": "\xff"}', "utf8"), (b'{"a": 1, "a": 1}', "duplicate_key"), (b'[{"a": {"b": 1, "b": 2}}]', "duplicate_key"), (b"{} {}", "syntax"), (b"", "syntax"), (b"NaN", "number"), (None, "syntax"), (b"[" * 100000, "syntax")]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, raw binary")
    found = {r.i: r.fault for r in rows.select("i", files.strict_json_fault("raw").alias("fault")).collect()}
    assert found == {i: fault for i, (_, fault) in enumerate(cases)}


def test_byte_evidence_and_images(spark, tmp_path):
    good = png()
    held = {"a.png": good, "b.jpg": JPEG, "c.png": good[:-20], "d.png": good[:40] + b"\x00" + good[41:], "e.bin": b"hello", "f.png": png(5000, 1)}
    for name, raw in held.items():
        (tmp_path / name).write_bytes(raw)
    read = files.read_bytes(spark, str(tmp_path))
    facts = {r.path.rpartition("/")[2]: r for r in files.byte_evidence(read).collect()}
    assert all(facts[n].sha256 == hashlib.sha256(b).hexdigest() and facts[n].length == len(b) for n, b in held.items())
    assert [facts[n].kind for n in sorted(held)] == ["png", "jpeg", "png", "png", None, "png"]
    seen = {r.path.rpartition("/")[2]: tuple(r.i) for r in read.select("path", files.inspect_image("content").alias("i")).collect()}
    assert seen["a.png"] == ("image/png", 3, 2, None) and seen["b.jpg"] == ("image/jpeg", 7, 5, None)
    assert seen["c.png"][3] == "truncated" and seen["d.png"][3] == "checksum" and seen["e.bin"][3] == "kind" and seen["f.png"] == ("image/png", 5000, 1, None)
    assert files.image_facts(good, most_pixels=5)[3] == "size"
    paths = {n: p for p in [r.path for r in read.collect()] for n in held if p.endswith(n)}
    declared = [(paths["a.png"], hashlib.sha256(good).hexdigest(), len(good)), (paths["b.jpg"], "0" * 64, len(JPEG)), (paths["e.bin"], "0" * 64, 4), ("nowhere", "0" * 64, 1)]
    issues = {r.path: r.code for r in files.evidence_issues(read, spark.createDataFrame(declared, "path string, sha256 string, length long")).collect()}
    assert issues == {paths["b.jpg"]: "sha256", paths["e.bin"]: "length", "nowhere": "missing"}
    assert files.read_bytes(spark, str(tmp_path), most=10).count() == 1
    items = sorted((r.item, r.path.rpartition("/")[2]) for r in files.staged_items(read).collect())
    assert items == [(i + 1, n) for i, n in enumerate(sorted(held))]


def test_publishing_is_once(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = spark.createDataFrame([("x",), ("y",), ("x",)], "body string")
    assert files.publish(rows, at, "body").count() == 0
    assert files.publish(rows, at, "body").count() == 0
    found = spark.read.parquet(at).collect()
    assert sorted(r.body for r in found) == ["x", "y"]
    assert all(r.sha == hashlib.sha256(r.body.encode()).hexdigest() for r in found)


def test_discovery_manifest_and_packages(spark, tmp_path):
    answers = [(json.dumps({"entries": [{"id": "1", "title": "t", "url": "u"}, {"id": "2", "webpage_url": "w", "duration": 3.5}, {"title": "no id"}]}),), (json.dumps({"id": "9", "title": "one"}),), ("not json",)]
    found = sorted(map(tuple, files.discovered(spark.createDataFrame(answers, "body string"), "body").collect()))
    assert found == [("1", "t", "u", None), ("2", "2", "w", 3.5), ("9", "one", None, None)]
    manifest = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "yes")], "id int, r string")
    chosen, missing = files.select_manifest(manifest, "id", F.col("r") == "yes", spark.createDataFrame([(2,), (7,), (7,)], "id int"))
    assert [r.id for r in chosen.collect()] == [2] and [r.id for r in missing.collect()] == [7]
    chosen, missing = files.select_manifest(manifest, "id", F.col("r") == "yes")
    assert sorted(r.id for r in chosen.collect()) == [1, 3] and missing.count() == 0
    files.write_packages(spark.createDataFrame([("s1", "# One"), ("s2", "# Two")], "skill_id string, text string"), str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p" / "skill_id=s2")).collect()] == ["# Two"]
