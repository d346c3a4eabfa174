"""Loading the driver's Parquet tables, and documents stored as JSON or CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task takes, about.
ROWS_A_TASK = 100_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of a stored table, dealt by ``keys`` to as many tasks as its size asks for: no task's share grows with the table.

    What is grouped by these keys, alone or with others, needs no shuffle of its own. The number is given, as packed sizes, by which
    Spark would join tasks, say little of a task's memory."""
    return rows.repartition(rows.count() // ROWS_A_TASK + 1, *keys)


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes ``df`` as Parquet below ``spark.checkpoint.dir`` and reads it again, without its lineage. ``options`` go to the writer.

    Where that is unset, a local session writes below its warehouse; on a cluster it is an error: executors could not share the folder."""
    spark = df.sparkSession
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
