"""The folder that driver and executors share: checkpoints and results of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a table in each task that it is dealt to.
TASK_ROWS = 500_000


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in spark.checkpoint.dir; where that is unset, in a folder of our own, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillstone/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """rows, written as Parquet in the shared folder and read again: what several branches read is made once, and outlives lost executors."""
    path = shared_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def tasks_for(rows: DataFrame, each: int = TASK_ROWS) -> int:
    """How many tasks hold at most about so many rows each: the session's partitions at least. The rows are counted, which is cheap for a table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def dealt(rows: DataFrame, *keys: str, each: int = TASK_ROWS) -> DataFrame:
    """rows by hash of keys in as many tasks as they call for: what follows by those keys needs no other exchange, and no task grows with the input.

    rows are counted, which is cheap for a table and for what stored() gives. A key's rows stay in one task.
    """
    return rows.repartition(tasks_for(rows, each), *keys)
