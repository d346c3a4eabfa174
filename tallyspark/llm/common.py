"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII blanks; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 continuation bytes: bytes that do not begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``text`` as UTF-8 bytes; bytes reach Python without being decoded."""
    return docs.select(*keep, F.col("text").cast("binary").alias("text"))


#: Rows and bytes of one step of a map.
ROWS, BYTES = 500, 8 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``ROWS`` rows and about ``BYTES``; at least one, of a row at least."""
    step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
    for a in range(0, max(1, batch.num_rows), step):
        yield batch.slice(a, step)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` small parts of the session's batches, so that what long texts grow into does not add up in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for batch in batches for part in sliced(batch))

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; empty batches are not passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return map_stream(df, run, schema)


def arm(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session takes one below the
    warehouse; on a cluster that is an error, since executors could not read a folder of the driver's machine."""
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir()


def own_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "step", **options) -> DataFrame:
    """Writes ``df`` as Parquet in the shared checkpoint folder and reads it again.

    The result does not depend on executors that computed it, its rows keep their places,
    and Python or shuffle work above it is done once. ``options`` go to the writer. ``discard`` removes one such table, ``clean`` all of a session."""
    spark = df.sparkSession
    at = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` wrote and that no result still to be computed reads."""
    for df in tables:
        mark = f"/tables-{df.sparkSession.sparkContext.applicationId}/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if mark in f}:
            remove(df.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Removes every table that ``materialise`` wrote in this session; results not yet written can no longer be computed."""
    remove(spark, own_dir(spark))


def with_before(counts: DataFrame, keys: list[str], order: str, value: str, block: int = 4096) -> DataFrame:
    """``counts`` with before: the sum of ``value`` over the rows of its ``keys`` whose ``order`` (whole numbers from 0, each once) is smaller.

    In two steps, over blocks of ``block`` orders and within them, so no task holds all rows of a key."""
    dealt = counts.withColumn("_b", F.expr(f"`{order}` div {block}"))
    ahead = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_b").agg(F.sum(value).alias("_n"))
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(ahead(keys, "_b")), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(ahead([*keys, "_b"], order)), F.lit(0))
    return dealt.withColumn("_in", within).join(sums, [*keys, "_b"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_b", "_in", "_base")


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, least: int = 1024) -> DataFrame:
    """``rows`` joined with ``table``, one row a key with ``n`` of its rows, whatever share of the ``total`` rows one key has.

    Keys of more than a 5,000th of all rows (and ``least``), which are 5,000 at most, are broadcast with a number of salts; their rows are
    dealt by key and salt, and their table rows repeated for each salt. Few rows are joined as they are."""
    if total <= 8 * least:
        return rows.join(table, key)
    most = max(least, total // 5000)
    salts = F.ceil(F.col(n) / most).cast("int")
    hot = F.broadcast(table.where(F.col(n) > most).select(key, salts.alias("_salts")))
    dealt = rows.join(hot, key, "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    each = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > most, salts - 1).otherwise(0))))
    return dealt.join(each, [key, "_s"]).drop("_s")
