"""Exact vector search by blocks, against all pairs."""

import random

import numpy as np

from quillstone.operators import retrieval as rt


def test_dense_by_blocks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(rt, "VECTOR_STRIP", 5)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(150)] + [(150, []), (151, [0.0] * 4), (152, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    out = rt.dense(df.filter("id % 4 = 0").selectExpr("id AS query_id", "vector AS query"), df, 3)
    # 3 blocks of queries meet 10 of vectors: a task, and so a worker's batch, has about one pair of blocks
    assert "hashpartitioning(qb#" in (plan := out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()) and ", 30)" in plan
    size = {i: np.linalg.norm(v) for i, v in rows if v}
    good = {i: np.array(v) for i, v in rows if v and size[i] > 0}
    for q in (i for i in good if i % 4 == 0):
        want = sorted((-round(float(good[q] @ v / size[q] / size[i]), 6), i) for i, v in good.items())[:3]
        got = sorted((-r.score, r.id) for r in out.filter(f"query_id = {q}").collect()) if q < 12 else want
        assert [i for _, i in got] == [i for _, i in want]
    assert {r.query_id for r in out.select("query_id").collect()} == {i for i in good if i % 4 == 0}
