"""Structured Streaming forms of the usage analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: 1970-01-01 was a Thursday: weeks begin four days later.
MONDAY = "4 days"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of events as a stream, with ts as an instant (watermarks need one)."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_stream(events: DataFrame, late: str = "7 days") -> DataFrame:
    """week_start, calls by tumbling weeks from Monday; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime=MONDAY).alias("w")).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("week_start"), "calls")


def trailing_stream(events: DataFrame, length: str = "1 hour", step: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, window_end, calls by sliding windows."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("calls")).select("user_id", F.col("w.end").alias("window_end"), "calls")


def first_seen_stream(events: DataFrame, late: str = "21 days") -> DataFrame:
    """Each user's first event within the watermark's reach: a stateful dedupe whose state expires."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"])


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """New documents are appended once, whatever comes again: each batch leaves out keys that the table has."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key).distinct(), key, "left_anti")
        except Exception as error:  # the table's first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
