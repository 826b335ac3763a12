"""Interval joins against all pairs, and quality annotations on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import annotations as an
from quillstone.operators import intervals

ROWS = "k int, id int, lo int, hi int"


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_a_cover_is_the_interval(spark, bits):
    top = (1 << bits) - 1
    pairs = [(lo, hi) for lo in range(-1, top + 2) for hi in range(-1, top + 3)]
    df = spark.createDataFrame(pairs, "lo int, hi int")
    for r in df.select("lo", "hi", intervals.cover(F.col("lo"), F.col("hi"), bits).alias("c")).collect():
        numbers = [n for level, node in r.c for n in range(node << level, (node + 1) << level)]
        assert sorted(numbers) == list(range(max(r.lo, 0), min(r.hi, top) + 1)), (r, bits)
        assert len(r.c) <= 2 * bits + 1


def some(rng, n, ids):
    return [(rng.randint(0, 2), i + ids, a, a + rng.choice([-1, 0, 1, 5, 90, 2000])) for i, a in enumerate(rng.randint(-3, 1030) for _ in range(n))] + [(1, ids - 1, None, 5), (1, ids - 2, 5, None), (None, ids - 3, 1, 9)]


def test_joins_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    left, right = some(rng, 150, 10), some(rng, 150, 1000)
    a = spark.createDataFrame(left, ROWS)
    b = spark.createDataFrame(right, ROWS).toDF("k", "other", "olo", "ohi")
    ok = lambda x: None not in x
    cut = lambda x: (max(x[2], 0), min(x[3], 1023))
    want = sorted((x[1], y[1]) for x in filter(ok, left) for y in filter(ok, right) if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and max(cut(x)[0], cut(y)[0]) <= min(cut(x)[1], cut(y)[1]))
    got = intervals.overlap_join(a, b, ["k"], "lo", "hi", "olo", "ohi", 10)
    assert sorted((r.id, r.other) for r in got.select("id", "other").collect()) == want and len(want) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    points = [(x[0], x[1], x[2]) for x in left]
    got = intervals.point_join(spark.createDataFrame(points, "k int, id int, at int"), b, ["k"], "at", "olo", "ohi", 10)
    assert sorted((r.id, r.other) for r in got.collect()) == sorted((p[1], y[1]) for p in points if None not in p and 0 <= p[2] < 1024 for y in filter(ok, right) if p[0] == y[0] and max(y[2], 0) <= p[2] <= y[3])


SERIES = "series_id string, first_period string, usable_from string, flags array<string>"
BREAKS = "series_id string, break_period string, kind string, affects_from string, affects_to string, affected string, invariant string"
REQUESTS = "request string, series_id string, lo string, hi string"


def noted(spark, requests, series, breaks):
    rows = an.annotated(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(series, SERIES), spark.createDataFrame(breaks, BREAKS)).collect()
    return {r.request: r for r in rows}


def test_breaks_in_and_around_a_range(spark):
    breaks = [("s", "FY2009", "accounting", "FY2006", None, "margins", "sales"), ("s", "FY2012", "scope", None, None, None, None), ("s", "FY2015", "accounting", None, "FY2018", None, None)]
    asked = [("in", "s", "FY2008", "FY2012"), ("edge", "s", "FY2009", "FY2011"), ("before", "s", "FY2001", "FY2006"), ("out", "s", "FY2001", "FY2005"), ("late", "s", "FY2013", "FY2016"), ("month", "s", "2009-01", "2012-12"), ("turned", "s", "FY2012", "FY2008")]
    got = noted(spark, asked, [("s", "FY1990", None, None)], breaks)
    told = {k: (r.breaks_in_range, [tuple(x) for x in r.breaks_affecting_range], r.caution, r.unchanged, r.notice) for k, r in got.items()}
    wide = ("FY2009", "FY2006", "FY2009")
    assert told == {
        "in": (["FY2009", "FY2012"], [], "margins", "sales", False), "edge": (["FY2009"][:0], [wide], None, None, True), "before": ([], [wide], None, None, True), "out": ([], [], None, None, False),
        "late": (["FY2015"], [], "ratios", None, False), "month": ([], [], None, None, False), "turned": ([], [], None, None, False),
    }
    assert got["out"].breaks == ["FY2009", "FY2012", "FY2015"] and got["out"].usable_from == "FY1990"


def test_series_with_nothing_to_say_give_no_row(spark):
    series = [("a", "2000", None, None), ("b", "2000", "2000", None), ("c", "2000", "2005", None), ("d", "2000", None, ["volatile"])]
    got = noted(spark, [(s, s, "2001", "2009") for s in "abcde"], series, [])
    assert sorted(got) == ["c", "d"] and got["c"].usable_from == "2005" and got["d"].flags == ["volatile"]


def test_a_panel_counts_its_breaks(spark):
    breaks = [(s, p, "accounting" if s == "a" else "scope", None, None, None, None) for s in "ab" for p in ("2003", "2005")] + [("b", "2007", "scope", None, None, None, None)]
    series = [(s, "2000", u, f) for s, u, f in (("a", "2001", None), ("b", "2002", ["small_cell"]), ("c", "2000", None))]
    rows = an.annotated(spark.createDataFrame([(f"{s}1", s, "2002", "2007") for s in "abc"], REQUESTS), spark.createDataFrame(series, SERIES), spark.createDataFrame(breaks, BREAKS))
    got = an.panel_summary(rows.withColumn("panel", F.lit(1)), "panel").first()
    assert (got.n_noted, got.n_caution, got.n_notice, got.n_flagged, got.usable_from_max, got.breaks_by_period) == (2, 1, 0, 1, "2002", {"2003": 2, "2005": 2, "2007": 1})


def test_overlap_totals_against_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(40), lo, lo + rng.randrange(-2, 9)) for lo in (rng.randrange(30) for _ in range(120))] + [("c", 1, 3, 9), ("c", 1, 4, 5), ("d", 1, 3, 9), (None, 1, 1, 2), ("d", 2, None, 9)]
    df = spark.createDataFrame(rows, "k string, id int, lo int, hi int")
    ok = [r for r in rows if None not in r and r[2] <= r[3]]
    pairs = [(a[0], min(a[3], b[3]) - max(a[2], b[2]) + 1) for a in ok for b in ok if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3]]
    want = sorted((k, sum(p[0] == k for p in pairs), sum(p[1] for p in pairs if p[0] == k)) for k in "ab")
    assert sorted(map(tuple, intervals.overlap_totals(df, ["k"], "id", "lo", "hi").collect())) == want


def test_overlap_totals_make_no_pairs(spark):
    """30,000 intervals that all overlap: 450 million pairs, counted from as many rows as there are ends."""
    df = spark.range(30_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 50).alias("lo"), F.lit(60).alias("hi"))
    want = sum(600 * (61 - d) * (600 * d + 299.5) for d in range(50))
    got = intervals.overlap_totals(df, ["k"], "id", "lo", "hi").first()
    assert (got.n_pairs, got.common) == (30_000 * 29_999 // 2, want)
