"""Usage analytics over the event log, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.functions.text import client_label
from quillstone.operators import usage
from quillstone.plans.adapters import table
from quillstone.plans.catalog import query
from quillstone.streaming import state
from quillstone.streaming.usage import event_stream, weekly_stream

KINDS = ["click", "view", "purchase", "signup", "error"]
WEEK = "strftime(date_trunc('week', ts), '%Y-%m-%d')"


@query(f"SELECT {WEEK} AS week, count(*) AS calls, count(DISTINCT user_id) AS users, {', '.join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in KINDS)} FROM events GROUP BY 1")
def usage_weekly(spark, sf):
    return usage.weekly(table(spark, sf, "events"), KINDS).withColumn("week", F.col("week").cast("string"))


@query("""WITH e AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM events), p AS (SELECT week, user_id, count(*) AS n, bool_and(event_type = 'view') AS lo FROM e GROUP BY 1, 2),
    k AS (SELECT p.*, EXISTS (SELECT 1 FROM events s WHERE s.user_id = p.user_id AND CAST(s.ts AS DATE) < p.week AND CAST(s.ts AS DATE) >= p.week - 21) AS known, (SELECT CAST(min(ts) AS DATE) FROM events) <= p.week - 21 AS whole FROM p)
    SELECT strftime(week, '%Y-%m-%d') AS week, count(*) AS users, CASE WHEN any_value(whole) THEN count(*) FILTER (NOT known) END AS new_users, max(n) AS most_calls, median(n) AS median_calls, count(*) FILTER (lo) AS list_only FROM k GROUP BY week""")
def usage_people(spark, sf):
    return usage.people(table(spark, sf, "events"), "view").withColumn("week", F.col("week").cast("string"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
    w(user_id, rn, older, newer, admitted, refused, peak) AS (SELECT user_id, rn, NULL::BIGINT, t, 1, 0, 1 FROM e WHERE rn = 1
        UNION ALL SELECT w.user_id, e.rn, CASE WHEN older > t - 86400000000 THEN older ELSE newer END, CASE WHEN older > t - 86400000000 THEN newer ELSE t END,
            admitted + CASE WHEN older > t - 86400000000 THEN 0 ELSE 1 END, refused + CASE WHEN older > t - 86400000000 THEN 1 ELSE 0 END, greatest(peak, CASE WHEN newer > t - 86400000000 THEN 2 ELSE 1 END)
        FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT user_id, CAST(arg_max(admitted, rn) AS BIGINT) AS admitted, CAST(arg_max(refused, rn) AS BIGINT) AS refused, CAST(max(peak) AS BIGINT) AS peak FROM w GROUP BY 1""")
def rate_limit(spark, sf):
    return usage.over_limit(table(spark, sf, "events"), 86400, 2)


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def trailing_calls(spark, sf):
    return usage.trailing(table(spark, sf, "events"), 3600).select("event_id", "user_id", "in_window")


AGENTS = ["Claude-User", "claude-user/1.0 (x)", " CLAUDE-USER ", "claude-user2", "openai-mcp/1.0.0", "openai-mcp", "Mozilla/5.0", "", None]
LABELS = ["claude", "claude", "claude", "other", "chatgpt", "other", "other", "other", "other"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, '{label}')" for n, label in enumerate(LABELS)) + ") AS t(n, label)")
def client_labels(spark, sf):
    return spark.createDataFrame(list(enumerate(AGENTS)), "n int, agent string").select("n", client_label(F.col("agent")).alias("label"))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_user_window(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).filter("ts > last - INTERVAL 1 DAY").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT event_id, user_id, coalesce(n, 0) AS n_then FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM events) WHERE event_type = 'click'")
def search_lookup_pairs(spark, sf):
    return usage.followed(table(spark, sf, "events"), "click", "purchase", 10).select("event_id", "user_id", "n_then")


@query("WITH g AS (SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT user_id, n, last_event, CASE WHEN v = 0 THEN 'zero' WHEN v < 5 THEN 'low' WHEN n >= 60 THEN 'frequent' END AS kind FROM g WHERE v < 5 OR n >= 60")
def triage_candidates(spark, sf):
    return usage.triaged(table(spark, sf, "events").filter("event_type <> 'error'"), "user_id", 5, 60)


@query(f"WITH o AS (SELECT {WEEK} AS week, count(*) AS calls FROM events WHERE event_type <> 'view' OR ts < TIMESTAMP '2024-01-10' GROUP BY 1), n AS (SELECT {WEEK} AS week, count(*) AS calls FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) SELECT coalesce(o.week, n.week) AS week, greatest(o.calls, n.calls) AS calls, CASE WHEN n.calls >= o.calls OR o.calls IS NULL THEN 'new' ELSE 'old' END AS taken FROM o FULL JOIN n ON o.week = n.week")
def weekly_merge(spark, sf):
    e = table(spark, sf, "events")
    part = lambda some: usage.weekly(some, []).select(F.col("week").cast("string").alias("week"), "calls")
    return usage.weekly_merge(part(e.filter("event_type <> 'view' OR ts < TIMESTAMP_NTZ '2024-01-10'")), part(e.filter("ts >= TIMESTAMP_NTZ '2024-01-10'")))


@query("WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM k GROUP BY 1, 2")
def user_sessions(spark, sf):
    return usage.sessions(table(spark, sf, "events"), 12 * 3600).select("user_id", "session", "n")


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS calls FROM events GROUP BY 1")
def streaming_weekly(spark, sf):
    """The weekly rollup as a stream that takes all files at hand and stops; complete mode keeps one row a week."""
    batch = table(spark, sf, "events")
    name = f"weekly_{uuid.uuid4().hex}"
    files = f"{sf}/events*.parquet"
    stream = weekly_stream(event_stream(spark, files, batch.schema), "30 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "calls")


#: A day's window of two calls; calls that ended in an error were turned away as busy.
_DECIDED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS busy, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT user_id, event_id, rn, t, -1e18::BIGINT AS older, CASE WHEN busy THEN -1e18::BIGINT ELSE t END AS newer, CASE WHEN busy THEN 'forgotten' ELSE 'admitted' END AS outcome, NULL::BIGINT AS wait FROM e WHERE rn = 1
        UNION ALL SELECT e.user_id, e.event_id, e.rn, e.t, CASE WHEN older > e.t - 86400000000 OR busy THEN older ELSE newer END, CASE WHEN older > e.t - 86400000000 OR busy THEN newer ELSE e.t END,
            CASE WHEN older > e.t - 86400000000 THEN 'refused' WHEN busy THEN 'forgotten' ELSE 'admitted' END, CASE WHEN older > e.t - 86400000000 THEN older + 86400000000 - e.t END
        FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT event_id, user_id, outcome, CAST(greatest(1, ceil(wait / 60000000.0)) AS INTEGER) * CASE WHEN outcome = 'refused' THEN 1 END AS minutes FROM w"""


def _calls_of(events):
    return events.withColumn("busy", F.col("event_type") == "error")


@query(_DECIDED)
def calls_decided(spark, sf):
    return state.admitted(_calls_of(table(spark, sf, "events")), 86400, 2).select("event_id", "user_id", "outcome", "minutes")


@query(_DECIDED)
def calls_decided_stream(spark, sf):
    """The same decisions by a stateful stream."""
    events = event_stream(spark, f"{sf}/events.parq*", table(spark, sf, "events").schema)
    return state.finished(state.admitted_stream(_calls_of(events), 86400, 2), "calls").select("event_id", "user_id", "outcome", "minutes")


_PROBES = """WITH RECURSIVE p AS (SELECT user_id::VARCHAR AS key, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'purchase' THEN 'ingest' ELSE 'probe' END AS kind, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' END AS signal FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day, kind = 'ingest', signal NULLS FIRST) AS rn FROM p),
    w AS (SELECT key, rn, day, kind, NULL::BOOLEAN AS changed, CASE WHEN kind = 'probe' THEN signal END AS signal, NULL::VARCHAR AS since, CASE WHEN kind = 'ingest' THEN day END AS ingested FROM d WHERE rn = 1
        UNION ALL SELECT key, rn, day, kind, changed, signal, CASE WHEN since IS NOT NULL AND ingested >= since THEN NULL ELSE since END, ingested
        FROM (SELECT d.key, d.rn, d.day, d.kind, CASE WHEN d.kind = 'probe' AND d.signal IS NOT NULL AND w.signal IS NOT NULL THEN d.signal <> w.signal END AS changed, CASE WHEN d.kind = 'probe' THEN coalesce(d.signal, w.signal) ELSE w.signal END AS signal,
                CASE WHEN d.kind = 'probe' AND d.signal IS NOT NULL AND w.signal IS NOT NULL AND d.signal <> w.signal THEN coalesce(w.since, d.day) ELSE w.since END AS since, CASE WHEN d.kind = 'ingest' THEN greatest(coalesce(w.ingested, d.day), d.day) ELSE w.ingested END AS ingested
            FROM w JOIN d ON d.key = w.key AND d.rn = w.rn + 1))
    SELECT key, day, changed, since, count(*) AS n FROM w WHERE kind = 'probe' GROUP BY ALL"""


def _probes_of(events):
    """Each user as a source: clicks and views are two signals, purchases are ingests, other events are failed probes."""
    kind = F.col("event_type")
    return events.select(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(kind == "purchase", "ingest").otherwise("probe").alias("kind"), F.when(kind == "click", "a").when(kind == "view", "b").alias("signal"))


@query(_PROBES)
def sources_pending(spark, sf):
    return state.pending(_probes_of(table(spark, sf, "events"))).groupBy("key", "day", "changed", "since").agg(F.count("*").alias("n"))


@query(_PROBES)
def sources_pending_stream(spark, sf):
    """The same changes by a stateful stream."""
    events = event_stream(spark, f"{sf}/events.parq*", table(spark, sf, "events").schema)
    return state.finished(state.pending_stream(_probes_of(events)), "pending").groupBy("key", "day", "changed", "since").agg(F.count("*").alias("n"))
