"""Usage analytics over an append-only event log (ts, user_id, event_type)."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly(events: DataFrame, kinds: list[str]) -> DataFrame:
    """week (its Monday), calls, users and a count for each kind."""
    return events.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), *(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds))


def people(events: DataFrame, list_kind: str, look_back: int = 21) -> DataFrame:
    """week, users, new users, most and median calls a user, users of list calls alone.

    A user is new if not seen in the look_back days before the week; null where the log doesn't reach back so far.
    """
    e = events.withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    per = e.groupBy("week", "user_id").agg(F.count("*").alias("n"), F.bool_and(F.col("event_type") == list_kind).alias("only"))
    seen = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    before = per.alias("p").join(seen.alias("s"), (F.col("p.user_id") == F.col("s.user_id")) & (F.col("s.day") < F.col("p.week")) & (F.col("s.day") >= F.date_sub(F.col("p.week"), look_back))).select("p.week", "p.user_id").distinct().withColumn("known", F.lit(True))
    start = events.agg(F.to_date(F.min("ts")).alias("start"))
    out = per.join(before, ["week", "user_id"], "left").crossJoin(F.broadcast(start))
    whole = F.first("start") <= F.date_sub(F.col("week"), look_back)
    return out.groupBy("week").agg(F.count("*").alias("users"), F.when(whole, F.count_if(F.col("known").isNull())).alias("new_users"), F.max("n").alias("most_calls"), F.percentile("n", 0.5).alias("median_calls"), F.count_if("only").alias("list_only"))


def weekly_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """A recomputed week replaces the old one unless it has fewer calls."""
    return old.alias("o").join(new.alias("n"), "week", "full").select("week", F.greatest("o.calls", "n.calls").alias("calls"), F.when(F.coalesce(F.col("n.calls") >= F.col("o.calls"), F.col("n.calls").isNotNull()), "new").otherwise("old").alias("taken"))


def trailing(events: DataFrame, seconds: int) -> DataFrame:
    """Each event with its user's events in the seconds up to it, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("at", at).withColumn("in_window", F.count("*").over(w)).drop("at")


def over_limit(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """user_id, admitted, refused, peak: a call is refused while most calls of the user's last seconds were admitted.

    Refused calls don't count, and a call exactly so many seconds old has left the window. Each user's calls are
    followed in order, in a stream of sorted rows: a task holds the times of one window, however many calls there are.
    """
    width = seconds * 1_000_000

    def follow(batches):
        user, held, counts = None, deque(), [0, 0, 0]
        for batch in batches:
            out = []
            for who, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if who != user:
                    if user is not None:
                        out.append((user, *counts))
                    user, held, counts = who, deque(), [0, 0, 0]
                while held and held[0] <= at - width:
                    held.popleft()
                if len(held) >= most:
                    counts[1] += 1
                    continue
                held.append(at)
                counts[0] += 1
                counts[2] = max(counts[2], len(held))
            yield _limits(out)
        if user is not None:
            yield _limits([(user, *counts)])

    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at").mapInArrow(follow, "user_id long, admitted long, refused long, peak long")


def _limits(rows: list[tuple]) -> pa.RecordBatch:
    names = ["user_id", "admitted", "refused", "peak"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)


def followed(events: DataFrame, first: str, then: str, within: int) -> DataFrame:
    """Events of kind first with the number of kind then in the user's next events, so many at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, within)
    return events.withColumn("n_then", F.sum(F.when(F.col("event_type") == then, 1).otherwise(0)).over(w)).filter(F.col("event_type") == first).withColumn("n_then", F.coalesce("n_then", F.lit(0)))


def triaged(events: DataFrame, key: str, low: float, often: int) -> DataFrame:
    """key, n, last event, kind: zero, low or frequent by the latest value and the number."""
    g = events.groupBy(key).agg(F.count("*").alias("n"), F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("last"))
    kind = F.when(F.col("last.value") == 0, "zero").when(F.col("last.value") < low, "low").when(F.col("n") >= often, "frequent")
    return g.select(key, "n", F.col("last.event_id").alias("last_event"), kind.alias("kind")).filter("kind IS NOT NULL")


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """user_id, session, begin, end, n: a pause longer than the gap begins another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > gap_seconds * 1_000_000, F.lit(True))
    return events.withColumn("f", fresh.cast("int")).withColumn("session", F.sum("f").over(w)).groupBy("user_id", "session").agg(F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))


#: Fixed value: days that a usage log is kept.
RETENTION_DAYS = 30


def retained(log: DataFrame, at: str, now, days: int = RETENTION_DAYS) -> DataFrame:
    """The rows of the last days up to now, a timestamp; rows without a time stay, as their age is unknown."""
    return log.filter(F.col(at).isNull() | (F.col(at) >= F.lit(now) - F.make_dt_interval(days=F.lit(days))))
