"""Semantic chunks against a plain loop over numpy vectors, and headings."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import chunking

ROWS = "doc int, n int, text string, vec array<float>"


def brute(rows, limit, percentile=0.95):
    out = []
    for doc in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == doc)
        vecs = [np.array(r[3] or [], np.float64) for r in mine]

        def far(a, b):
            size = np.sqrt(a @ a) * np.sqrt(b @ b) if len(a) and len(b) else 0
            return round(1 - a @ b / size, 9) if size else None

        gaps = [far(a, b) for a, b in zip(vecs, vecs[1:])]
        known = [g for g in gaps if g is not None]
        most = np.percentile(known, percentile * 100) if known else 0
        chunk, runs = 0, [[mine[0]]]
        for r, g in zip(mine[1:], gaps):
            if g is not None and g > most + 1e-12:
                runs.append([])
            runs[-1].append(r)
        for chunk, run in enumerate(runs):
            parts, now = [], ""
            for piece in (t[i : i + limit] for _, _, t, _ in run for i in range(0, len(t or ""), limit)):
                if now and len(now) + len(piece) + 1 > limit:
                    parts.append(now)
                    now = ""
                now = f"{now} {piece}" if now else piece
            parts += [now] if now else []
            out += [(doc, chunk, k, p, run[0][1], run[-1][1]) for k, p in enumerate(parts)]
    return sorted(out)


def test_chunks_are_those_of_a_plain_loop(spark):
    rng = random.Random(2)
    rows = []
    for doc, n in enumerate([1, 2, 3, 21, 41, 60, 200]):
        at = [rng.gauss(0, 1) for _ in range(6)]
        for i in range(n):
            at = [x + rng.gauss(0, 3 if rng.random() < 0.1 else 0.2) for x in at]
            rows.append((doc, i * 3, rng.choice(["x" * rng.randint(1, 90), "y" * 130, ""]), [float(np.float32(x)) for x in at]))
    rows += [(50, i, "same", [1.0, 1.0]) for i in range(30)] + [(51, 0, "no vector", None), (51, 1, "none", [0.0, 0.0]), (51, 2, "one", [1.0, 0.0]), (51, 3, None or "", [0.0, 1.0]), (51, 4, "end", [0.0, 1.0])]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = chunking.semantic_chunks(df, "doc", "n", "text", "vec", 100).select("doc", "chunk", "part", "text", "first", "last").collect()
    assert sorted(map(tuple, got)) == brute(rows, 100)
    assert chunking.semantic_chunks(df.limit(0), "doc", "n", "text", "vec", 100).collect() == []


def test_sentences_are_read_once_and_parts_made_once(spark):
    df = spark.createDataFrame([(1, 0, "a", [1.0]), (1, 1, "b", [2.0])], ROWS)
    plan = chunking.semantic_chunks(df, "doc", "n", "text", "vec", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("aggregate(") == 1


def test_distances_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([3.0], [4.0]), ([1.0, None], [1.0, 1.0]), ([1.0], [1.0, 0.0]), ([], []), (None, [1.0]), ([0.0], [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").coalesce(1)
    assert [r[0] for r in df.select(chunking.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0] + [None] * 5


def test_headings(spark):
    rows = [("utterance", "会議", 3, "2024-05-01", "議事録", "鈴木委員", None, None, None), ("page", "会議", 3, None, "資料", None, "資料1", "（案）概要", 7), ("page", "会議", 3, "", "資料", "事務局", "", "概要", 1)]
    df = spark.createDataFrame(rows, "a string, b string, c int, d string, e string, f string, g string, h string, i int")
    got = [r[0] for r in df.select(chunking.heading(*(F.col(c) for c in "abcdefghi"))).collect()]
    assert got == ["会議 第3回（2024-05-01）議事録・鈴木委員：", "会議 第3回（日付なし）資料1 概要 p7・不明：", "会議 第3回（）概要 p1・事務局：".replace("（）", "（日付なし）")]


def test_vectors_that_are_not_broadcast_change_nothing(spark, monkeypatch):
    from quillstone.plans import text_queries as tq

    sf = "/root/testdata/sf0.001"
    first = sorted(map(tuple, tq.semantic_chunks(spark, sf).collect()))
    monkeypatch.setattr(tq.rt, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, tq.semantic_chunks(spark, sf).collect())) == first
