"""Documents, tables and bytes in files: JSON documents, JSON lines, checked CSV, byte evidence and images."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a JSON file, with its ``file_name``; files that are not of ``schema`` are left out."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return read.select("*", F.col("_metadata.file_name").alias("file_name"))


def write_documents(df: DataFrame, path: str) -> None:
    """Replaces what is at ``path``; readers see the old files or the new ones."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line; a line that is no JSON of ``schema`` stops the read, blank lines are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """String columns under exactly the header ``columns``; quoted fields may span lines, and each row must be as wide as the header."""
    read = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    found = read.csv(path).columns
    if found != list(columns):
        raise ValueError(f"header {found} is not {list(columns)}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def json_fault(raw: bytes | None) -> str | None:
    """Why ``raw`` is no strict JSON: bom, utf8, duplicate_key, number, or syntax (trailing data too); None if it is."""
    if raw is None or raw.startswith(b"\xef\xbb\xbf"):
        return "syntax" if raw is None else "bom"

    def unique(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise KeyError
        return dict(pairs)

    def no_constant(name: str) -> None:
        raise OverflowError(name)

    try:
        json.loads(raw.decode("utf-8"), object_pairs_hook=unique, parse_constant=no_constant)
    except UnicodeDecodeError:
        return "utf8"
    except KeyError:
        return "duplicate_key"
    except OverflowError:
        return "number"
    except (ValueError, RecursionError):
        return "syntax"
    return None


@F.pandas_udf(T.StringType())
def strict_json_fault(raw: pd.Series) -> pd.Series:
    """``json_fault`` of a binary column."""
    return raw.map(lambda b: json_fault(None if b is None else bytes(b)))


def read_bytes(spark: SparkSession, path: str, least: int = 0, most: int = 1 << 30) -> DataFrame:
    """(path, length, content) of the files at ``path`` whose length lies within bounds; the bound reaches the scan, so larger files are not opened."""
    return spark.read.format("binaryFile").load(path).where(F.col("length").between(least, most)).select("path", "length", "content")


def media_kind(content: Column) -> Column:
    """What the first bytes say: png, jpeg, pdf, zip, mp4 or null."""
    head = lambda n, at=1: F.hex(F.substring(content, at, n))
    return (
        F.when(head(8) == "89504E470D0A1A0A", "png").when(head(3) == "FFD8FF", "jpeg").when(head(4) == "25504446", "pdf").when(head(4) == "504B0304", "zip").when(head(4, 5) == "66747970", "mp4")
    )


def byte_evidence(files: DataFrame) -> DataFrame:
    """(path, length, sha256, kind) of ``read_bytes`` rows."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), media_kind(F.col("content")).alias("kind"))


def evidence_issues(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, code) where ``declared`` (path, sha256, length) differs from the files: missing, length or sha256."""
    both = declared.alias("d").join(byte_evidence(files).alias("f"), "path", "left")
    code = F.when(F.col("f.sha256").isNull(), "missing").when(~F.col("d.length").eqNullSafe(F.col("f.length")), "length").when(~F.col("d.sha256").eqNullSafe(F.col("f.sha256")), "sha256")
    return both.select("path", code.alias("code")).where("code is not null")


def image_facts(raw: bytes, most_pixels: int = 1 << 24) -> tuple[str | None, int | None, int | None, str | None]:
    """(mime, width, height, fault). A PNG's chunks are walked with their checksums and its pixels inflated;
    a JPEG's segments are walked to its frame header and end mark."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        at, width, height, data, ended = 8, None, None, [], False
        while at + 12 <= len(raw) and not ended:
            (n,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
            if at + 12 + n > len(raw):
                return "image/png", width, height, "truncated"
            if struct.unpack_from(">I", raw, at + 8 + n)[0] != zlib.crc32(raw[at + 4 : at + 8 + n]):
                return "image/png", width, height, "checksum"
            if width is None:
                if kind != b"IHDR" or n != 13:
                    return "image/png", None, None, "header"
                width, height = struct.unpack_from(">II", raw, at + 8)
                if not width or not height or width * height > most_pixels:
                    return "image/png", width, height, "size"
            elif kind == b"IDAT":
                data.append(raw[at + 8 : at + 8 + n])
            ended, at = kind == b"IEND", at + 12 + n
        try:
            inflate = zlib.decompressobj()
            inflate.decompress(b"".join(data), 16 * most_pixels)
        except zlib.error:
            return "image/png", width, height, "pixels"
        return "image/png", width, height, None if ended and at == len(raw) and inflate.eof else "truncated"
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF:
            mark, (n,) = raw[at + 1], struct.unpack_from(">H", raw, at + 2)
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(raw):
                height, width = struct.unpack_from(">HH", raw, at + 5)
                fault = "size" if not width or not height or width * height > most_pixels else None if raw.rstrip(b"\0").endswith(b"\xff\xd9") else "truncated"
                return "image/jpeg", width, height, fault
            at += 2 + n
        return "image/jpeg", None, None, "header"
    return None, None, None, "kind"


IMAGE = T.StructType([T.StructField("mime", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("fault", T.StringType())])


@F.pandas_udf(IMAGE)
def inspect_image(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``image_facts`` of a binary column."""
    for raw in batches:
        rows = [image_facts(bytes(b or b"")) for b in raw]
        yield pd.DataFrame(rows, columns=["mime", "width", "height", "fault"]).astype({"width": "Int32", "height": "Int32"})


def publish(df: DataFrame, path: str, content: str) -> DataFrame:
    """Writes rows with ``sha``, the hex of ``content``'s hash, once: an address that is there already must hold the same text, and is left as it is.

    Returns (sha, code) of addresses whose text differs; nothing is written for those. The store has a folder for each of the 256 first
    bytes of a hash, and only those that the new rows fall into are read."""
    spark = df.sparkSession
    rows = df.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256)).withColumn("bucket", F.concat(F.lit("b"), F.left("sha", F.lit(2)))).dropDuplicates(["sha"])
    buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # 256 at most
    try:
        there = spark.read.parquet(path).where(F.col("bucket").isin(buckets)).select("sha", F.col(content).alias("stored"))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        there = spark.createDataFrame([], "sha string, stored string")
    rows.join(there, "sha", "left_anti").write.partitionBy("bucket").mode("append").parquet(path)
    return rows.join(there, "sha").where(~F.col(content).eqNullSafe(F.col("stored"))).select("sha", F.lit("content").alias("code"))


def staged_items(files: DataFrame) -> DataFrame:
    """(path, item) of ``read_bytes`` rows: numbered in order of their names, in two steps so that no task holds all rows."""
    rows = files.select("path").repartitionByRange(F.col("path")).withColumn("part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    base = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(base.select("part", before.alias("before")), "part").select("path", (F.col("before") + F.col("within")).alias("item"))


def discovered(answers: DataFrame, body: str, limit: int = 50) -> DataFrame:
    """(source_id, title, url, seconds) of the entries in tools' JSON answers (a list of entries, or one), at most ``limit`` an answer."""
    entry = "struct<id:string,title:string,webpage_url:string,url:string,duration:double>"
    parsed = F.from_json(body, f"id string, title string, webpage_url string, url string, duration double, entries array<{entry}>")
    rows = answers.select(parsed.alias("p")).where("p is not null")
    one = F.array(F.struct(*[F.col(f"p.{c}") for c in ("id", "title", "webpage_url", "url", "duration")]))
    rows = rows.select(F.explode(F.slice(F.coalesce("p.entries", one), 1, max(1, min(limit, 50)))).alias("e")).where("e.id is not null")
    return rows.select(F.col("e.id").alias("source_id"), F.coalesce("e.title", "e.id").alias("title"), F.coalesce("e.webpage_url", "e.url").alias("url"), F.col("e.duration").alias("seconds"))


def select_manifest(manifest: DataFrame, key: str, recommended: Column, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected rows, wanted keys that the manifest lacks): the wanted ones, or without a wish the recommended ones."""
    if wanted is None:
        return manifest.where(recommended), manifest.select(key).where("false")
    asked = wanted.select(key).distinct()
    return manifest.join(asked, key, "left_semi"), asked.join(manifest, key, "left_anti")


def write_packages(skills: DataFrame, path: str, key: str = "skill_id") -> None:
    """Each skill's text document (key, text) in a folder of its own."""
    skills.select(key, "text").write.partitionBy(key).mode("overwrite").text(path)
