"""Writers: replace partitions, swap a table's current version, append events, fingerprint contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: str, order: list[str]) -> None:
    """Overwrite just the partitions that rows has, each in order."""
    rows.repartition(by).sortWithinPartitions(by, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def swap_version(rows: DataFrame, root: str, version: str) -> str:
    """Write a version beside the others and point `current` at it, last: readers see a whole version at any time."""
    path = f"{root}/versions/{version}"
    rows.write.mode("errorifexists").parquet(path)
    point_at(rows.sparkSession, root, path)
    return path


def point_at(spark: SparkSession, root: str, path: str) -> None:
    """From now on readers of root see the version at this path."""
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.json(f"{root}/current").first()["path"])


def fingerprint(rows: DataFrame) -> DataFrame:
    """rows and a number that depends on the contents, not on their order: enough to skip an unchanged export."""
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(20,0)")).cast("string").alias("fingerprint"))


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
