"""Stateful streams and their batch forms: admission of calls, and changes of sources that wait to be taken in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillstone.sources.shared import shared_path

MICROS = 1_000_000
DECISIONS = "user_id long, event_id long, outcome string, minutes int"
CHANGES = "key string, day string, changed boolean, since string"


def admission(held: list[int], calls: Iterable[tuple[int, int, bool]], seconds: int, most: int) -> Iterator[tuple[int, str, int | None]]:
    """(id, outcome, minutes) of one user's calls (time in microseconds, id, busy) in order; held is the state, changed in place.

    A call is refused while most calls within the last seconds count, with the minutes until one leaves the window, 1 at
    least. A call that was turned away as busy was not run: it is forgotten and counts for none after it. A call exactly
    so many seconds old has left the window. held has most times at most.
    """
    width = seconds * MICROS
    for at, id_, busy in calls:
        while held and held[0] <= at - width:
            held.pop(0)
        if len(held) >= most:
            yield id_, "refused", max(1, -(-(held[0] + width - at) // (60 * MICROS)))
        elif busy:
            yield id_, "forgotten", None
        else:
            held.append(at)
            yield id_, "admitted", None


def carried(state: tuple, rows: Iterable[tuple[str, str, str | None]]) -> Iterator[tuple[tuple, str, bool | None, str | None]]:
    """(state, day, changed, since) of one source's rows (day, kind, signal) in order; state is (signal, since, ingested).

    A probe with a signal has changed if the one before had another; the first, and one that failed (no signal), can't
    tell. since is the day on which a change was first seen; it stays until an ingest of that day or later. kind is
    probe or ingest; an ingest gives no row.
    """
    signal, since, ingested = state
    for day, kind, now in rows:
        if kind == "ingest":
            ingested = max(ingested or "", day)
            changed = None
        else:
            changed = None if not now or not signal else now != signal
            signal = now or signal
            since = since or day if changed else since
        if since and ingested and ingested >= since:
            since = None
        if kind == "probe":
            yield (signal, since, ingested), day, changed, since
    # the state after an ingest at the end
    yield (signal, since, ingested), None, None, None


class _Admission(StatefulProcessor):
    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = sorted(chain.from_iterable(zip(f["at"].tolist(), f["event_id"].tolist(), f["busy"].tolist()) for f in rows))
        held = list(self.held.get()[0]) if self.held.exists() else []
        out = list(admission(held, calls, self.seconds, self.most))
        # whom nobody hears of for a whole window has nothing that counts: their state goes
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held:
            self.held.update((held,))
            self.handle.registerTimer(held[-1] // 1000 + self.seconds * 1000)
        elif self.held.exists():
            self.held.clear()
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": [o[0] for o in out], "outcome": [o[1] for o in out], "minutes": pd.array([o[2] for o in out], "Int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Pending(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "signal string, since string, ingested string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text = lambda column: [x if isinstance(x, str) else None for x in column]
        each = sorted(chain.from_iterable(zip(text(f["day"]), text(f["kind"]), text(f["signal"])) for f in rows), key=_by_day)
        state, out = tuple(self.state.get()) if self.state.exists() else (None, None, None), []
        for state, day, changed, since in carried(state, each):
            if day is not None:
                out.append((key[0], day, changed, since))
        self.state.update(state)
        yield pd.DataFrame({"key": [o[0] for o in out], "day": [o[1] for o in out], "changed": pd.array([o[2] for o in out], "boolean"), "since": [o[3] for o in out]})

    def close(self) -> None:
        pass


def _by_day(row: tuple) -> tuple:
    """A day's probes come before its ingests: an ingest of the day of a change has taken it in."""
    return row[0], row[1] != "probe", row[2] or ""


def _calls(events: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").cast("long"), F.col("event_id").cast("long"), at, F.coalesce("busy", F.lit(False)).alias("busy"), F.col("ts").cast("timestamp").alias("ts"))


def admitted_stream(events: DataFrame, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id, outcome (admitted, refused or forgotten), minutes, for a stream of event_id, user_id, ts, busy.

    A user's calls are decided batch by batch, in order of time within a batch; so the stream should come in order, and a
    batch be bounded (maxFilesPerTrigger), as it is sorted by user in memory. The state of a user is most times at most;
    it goes by a timer once the watermark is a window beyond the last call that counts. Needs the RocksDB state store.
    """
    rows = _calls(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
    return rows.groupBy("user_id").transformWithStateInPandas(_Admission(seconds, most), DECISIONS, "Append", "EventTime")


def pending_stream(probes: DataFrame) -> DataFrame:
    """key, day, changed, since, for a stream of key, day (YYYY-MM-DD), kind (probe or ingest) and signal, as carried says."""
    return probes.select("key", "day", "kind", "signal").groupBy("key").transformWithStateInPandas(_Pending(), CHANGES, "Append", "None")


def _followed(rows: DataFrame, order: list[str], each: Callable, schema: str) -> DataFrame:
    """each(key, rows of it in order) over rows dealt by their first column and sorted: no task holds a key's rows."""
    names = rows.columns

    def run(batches):
        stream = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        out = []
        for key, group in groupby(stream, lambda r: r[0]):
            for row in each(key, (r[1:] for r in group)):
                out.append(row)
                if len(out) == 5000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return rows.repartition(names[0]).sortWithinPartitions(names[0], *order).mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def admitted(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """The batch form of admitted_stream: each user's calls by time and event_id."""
    rows = _calls(events).select("user_id", "at", "event_id", "busy")
    return _followed(rows, ["at", "event_id"], lambda user, calls: ((user, *o) for o in admission([], calls, seconds, most)), DECISIONS)


def pending(probes: DataFrame) -> DataFrame:
    """The batch form of pending_stream: each source's rows by day, probes before ingests."""
    rows = probes.select("key", "day", "kind", "signal").withColumn("after", F.col("kind") != "probe")
    kept = rows.select("key", "day", "kind", "signal", "after")
    return _followed(kept, ["day", "after", "signal"], lambda key, each: ((key, *o[1:]) for o in carried((None, None, None), (r[:3] for r in each)) if o[1] is not None), CHANGES)


def finished(stream: DataFrame, tag: str) -> DataFrame:
    """Run a stream over all that is there now; its rows are written to the shared folder, exactly once, and read from there."""
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, tag), shared_path(spark, f"{tag}-state")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return spark.read.schema(StructType(stream.schema.fields)).parquet(path)
