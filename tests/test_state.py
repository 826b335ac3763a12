"""Stateful streams against their batch forms and against plain loops; states that go when their time is over."""

import datetime
import random

import pytest

from quillstone.streaming import state

EVENTS = "event_id long, user_id long, ts timestamp, busy boolean"
T0 = datetime.datetime(2024, 5, 1)


def some_events(n, seed):
    rng, at, out = random.Random(seed), T0, []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice([0, 1, 20, 300, 1500]))
        out.append((i, rng.choice([1, 1, 1, 2, 3]), at, rng.choice([True, False, False, None])))
    return out


def decided(events, seconds, most):
    held, out = {}, []
    for id_, user, at, busy in sorted(events, key=lambda e: (e[2], e[0])):
        mine = [t for t in held.get(user, []) if (at - t).total_seconds() < seconds]
        if len(mine) >= most:
            left = (mine[0] - at).total_seconds() + seconds
            out.append((user, id_, "refused", max(1, -int(-left // 60))))
        elif busy:
            out.append((user, id_, "forgotten", None))
        else:
            mine.append(at)
            out.append((user, id_, "admitted", None))
        held[user] = mine
    return sorted(out)


def plain(rows):
    return sorted(tuple(r) for r in rows)


def test_admission_forgets_busy_calls_and_closes_its_window():
    s = 1_000_000
    held = []
    got = list(state.admission(held, [(0, 1, False), (1 * s, 2, True), (2 * s, 3, False), (3 * s, 4, False), (3599 * s, 5, False), (3600 * s, 6, False)], 3600, 2))
    assert got == [(1, "admitted", None), (2, "forgotten", None), (3, "admitted", None), (4, "refused", 60), (5, "refused", 1), (6, "admitted", None)]
    assert held == [2 * s, 3600 * s]


@pytest.mark.parametrize("most", [1, 3])
def test_batch_decisions_are_those_of_a_plain_loop(spark, most):
    events = some_events(400, most) + [(1000, None, T0, False), (1001, 5, None, False)]
    got = state.admitted(spark.createDataFrame(events, EVENTS).repartition(4), 3600, most)
    assert plain(got.collect()) == decided([e for e in events if e[1] and e[2]], 3600, most)
    assert state.admitted(spark.createDataFrame([], EVENTS), 3600, 1).collect() == []


def files_of(spark, tmp_path, rows, schema, parts):
    """A folder with a file for each part of the rows, in order of time."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        path = f"{tmp_path}/part-{i}"
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))


def test_a_stream_in_batches_decides_alike(spark, tmp_path):
    """Five batches: windows go over their borders, and the batch form knows none."""
    events = some_events(300, 7)
    stream = files_of(spark, tmp_path, events, EVENTS, 5)
    got = state.finished(state.admitted_stream(stream, 3600, 2), "test")
    assert plain(got.collect()) == decided(events, 3600, 2)


def test_the_state_of_idle_users_goes(spark, tmp_path):
    late = T0 + datetime.timedelta(days=3)
    events = [(i, i, T0, False) for i in range(20)] + [(100 + i, 99, late + datetime.timedelta(minutes=i), False) for i in range(3)]
    for i, part in enumerate((events[:20], events[20:21], events[21:22], events[22:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/part-{i}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = state.admitted_stream(stream, 3600, 2).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    held = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "held").load()
    assert [r.key.user_id for r in held.select("key").collect()] == [99]


PROBES = "key string, day string, kind string, signal string"


def test_changes_wait_until_they_are_taken_in(spark, tmp_path):
    a = [("2024-01-01", "probe", "x"), ("2024-01-02", "probe", "x"), ("2024-01-03", "probe", "y"), ("2024-01-04", "probe", None), ("2024-01-05", "probe", "z"), ("2024-01-05", "ingest", None), ("2024-01-06", "probe", "z"), ("2024-01-07", "probe", "w"), ("2024-01-07", "ingest", None), ("2024-01-08", "probe", "w")]
    want = [("2024-01-01", None, None), ("2024-01-02", False, None), ("2024-01-03", True, "2024-01-03"), ("2024-01-04", None, "2024-01-03"), ("2024-01-05", True, "2024-01-03"), ("2024-01-06", False, None), ("2024-01-07", True, "2024-01-07"), ("2024-01-08", False, None)]
    rows = [("a", *r) for r in a] + [("b", "2024-01-09", "ingest", None), ("b", "2024-01-10", "probe", "x")]
    want = sorted([("a", *w) for w in want] + [("b", "2024-01-10", None, None)], key=str)
    df = spark.createDataFrame(rows, PROBES)
    assert sorted((tuple(r) for r in state.pending(df.repartition(3)).collect()), key=str) == want
    stream = files_of(spark, tmp_path, rows, PROBES, 4)
    assert sorted((tuple(r) for r in state.finished(state.pending_stream(stream), "test").collect()), key=str) == want
