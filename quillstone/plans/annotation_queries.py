"""Breaks of series against asked ranges, panels of annotated series, and shipments under way by interval joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import annotations as an
from quillstone.operators import intervals
from quillstone.plans.adapters import SERIES, series_values, table
from quillstone.plans.catalog import query

_AT = "CASE freq WHEN 'a' THEN CAST({y} AS VARCHAR) WHEN 'q' THEN {y} || 'Q' || sub ELSE {y} || '-' || lpad(CAST(sub AS VARCHAR), 2, '0') END"
QUALITY = f"""{SERIES}, v AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY year, sub) AS before, min(period) OVER (PARTITION BY series_id) AS first_period FROM sv),
br AS (SELECT series_id, measure, freq, year, sub, period AS break_period, CASE WHEN measure = 'value' AND value > before THEN 'accounting' ELSE 'scope' END AS kind,
    CASE WHEN seg <> 'all' THEN {_AT.format(y="(year - 1)")} END AS affects_from, CASE WHEN prio <> 'all' THEN {_AT.format(y="(year + 1)")} END AS affects_to, CASE WHEN prio = 'p1' THEN 'margins' END AS affected, CASE WHEN seg = 'all' THEN 'totals' END AS invariant
    FROM v WHERE value > 1.6 * before OR value < before / 1.6),
me AS (SELECT series_id, any_value(org) AS org, any_value(first_period) AS first_period, max(CASE WHEN sub <= 1 AND year = 1996 AND seg = 'building' THEN period END) AS usable_from, bool_or(prio = 'p5' AND freq = 'm' AND value < 3) AS small FROM v GROUP BY 1),
rq AS (SELECT series_id || '/' || year AS request, any_value(org) AS org, series_id, min(period) AS lo, max(period) AS hi FROM (SELECT org, series_id, y.year, period FROM sv JOIN (SELECT unnest(range(1992, 1999, 2)) AS year) y ON sv.year BETWEEN y.year AND y.year + 2) GROUP BY request, series_id),
an AS (SELECT rq.*, coalesce(me.usable_from, me.first_period) AS usable_from, me.small,
    (SELECT count(*) FROM br WHERE br.series_id = rq.series_id) AS n_breaks,
    coalesce((SELECT list(break_period ORDER BY break_period) FROM br WHERE br.series_id = rq.series_id AND lo < break_period AND break_period <= hi), []) AS inside,
    coalesce((SELECT list(break_period ORDER BY break_period) FROM br WHERE br.series_id = rq.series_id AND NOT (lo < break_period AND break_period <= hi) AND affects_from <= hi AND coalesce(affects_to, break_period) >= lo), []) AS around,
    (SELECT arg_min(coalesce(affected, 'ratios'), break_period) FROM br WHERE br.series_id = rq.series_id AND lo < break_period AND break_period <= hi AND kind = 'accounting') AS caution,
    (SELECT arg_min(coalesce(invariant, ''), break_period) FROM br WHERE br.series_id = rq.series_id AND lo < break_period AND break_period <= hi AND kind = 'accounting') AS unchanged,
    (SELECT count(*) FROM br WHERE br.series_id = rq.series_id AND NOT (lo < break_period AND break_period <= hi) AND affects_from <= hi AND coalesce(affects_to, break_period) >= lo AND kind = 'accounting') AS n_around
    FROM rq JOIN me ON me.series_id = rq.series_id),
qa AS (SELECT * FROM an JOIN (SELECT series_id AS s, first_period FROM me) ON s = series_id WHERE n_breaks > 0 OR small OR usable_from <> first_period)"""


def asked(spark, sf):
    """(requests, series, breaks): jumps of a series' values are its breaks; each series is asked for in ranges of three years."""
    values = series_values(spark, sf)
    w = Window.partitionBy("series_id").orderBy("year", "sub")
    v = values.withColumn("before", F.lag("value").over(w))
    at = lambda year: F.when(F.col("freq") == "a", year.cast("string")).when(F.col("freq") == "q", F.concat(year, F.lit("Q"), "sub")).otherwise(F.concat(year, F.lit("-"), F.lpad(F.col("sub").cast("string"), 2, "0")))
    jumps = v.filter("value > 1.6 * before OR value < before / 1.6")
    breaks = jumps.select(
        "series_id", F.col("period").alias("break_period"), F.when((F.col("measure") == "value") & (F.col("value") > F.col("before")), an.ACCOUNTING).otherwise("scope").alias("kind"),
        F.when(F.col("seg") != "all", at(F.col("year") - 1)).alias("affects_from"), F.when(F.col("prio") != "all", at(F.col("year") + 1)).alias("affects_to"),
        F.when(F.col("prio") == "p1", "margins").alias("affected"), F.when(F.col("seg") == "all", "totals").alias("invariant"),
    )
    usable = F.max(F.when((F.col("sub") <= 1) & (F.col("year") == 1996) & (F.col("seg") == "building"), F.col("period")))
    small = F.max((F.col("prio") == "p5") & (F.col("freq") == "m") & (F.col("value") < 3))
    series = values.groupBy("series_id").agg(F.min("period").alias("first_period"), usable.alias("usable_from"), F.when(small, F.array(F.lit("small_cell"))).alias("flags"))
    starts = F.filter(F.array(*(F.lit(y) for y in range(1992, 1999, 2))), lambda y: F.col("year").between(y, y + 2))
    requests = values.withColumn("y", F.explode(starts)).groupBy("org", "series_id", "y").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    return requests.withColumn("request", F.concat("series_id", F.lit("/"), F.col("y").cast("string"))), series, breaks


@query(f"WITH {QUALITY} SELECT request, lo, hi, usable_from, n_breaks, array_to_string(inside, ',') AS inside, array_to_string(around, ',') AS around, caution, nullif(unchanged, '') AS unchanged, n_around > 0 AND caution IS NULL AS notice, small AS flagged FROM qa")
def series_quality(spark, sf):
    rows = an.annotated(*asked(spark, sf))
    join = lambda c: F.array_join(c, ",")
    return rows.select(
        "request", "lo", "hi", "usable_from", F.size("breaks").cast("long").alias("n_breaks"), join("breaks_in_range").alias("inside"), join(F.transform("breaks_affecting_range", lambda x: x.break_period)).alias("around"),
        "caution", "unchanged", "notice", F.col("flags").isNotNull().alias("flagged"),
    )


@query(
    f"""WITH {QUALITY}, p AS (SELECT org, unnest(inside) AS per FROM qa), c AS (SELECT org, array_to_string(list(per || ':' || n ORDER BY per), ',') AS breaks_by_period FROM (SELECT org, per, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT org, count(DISTINCT series_id) AS n_noted, count(caution) AS n_caution, count(*) FILTER (n_around > 0 AND caution IS NULL) AS n_notice, count(*) FILTER (small) AS n_flagged, max(usable_from) AS usable_from_max FROM qa GROUP BY 1)
    SELECT s.*, coalesce(breaks_by_period, '') AS breaks_by_period FROM s LEFT JOIN c ON c.org = s.org"""
)
def panel_breaks(spark, sf):
    requests, series, breaks = asked(spark, sf)
    rows = an.annotated(requests, series, breaks).withColumn("org", F.substring_index("series_id", ".", 1))
    each = F.transform(F.array_sort(F.map_entries("breaks_by_period")), lambda e: F.concat(e.key, F.lit(":"), e.value.cast("string")))
    return an.panel_summary(rows, "org").withColumn("breaks_by_period", F.array_join(each, ","))


@query(
    """WITH i AS (SELECT l_suppkey AS supplier, l_orderkey * 10 + l_linenumber AS id, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS lo, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS hi FROM lineitem)
    SELECT a.supplier, count(*) AS n_pairs, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) AS days FROM i a JOIN i b ON a.supplier = b.supplier AND a.id < b.id AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1"""
)
def shipments_under_way(spark, sf):
    """Pairs of one supplier's shipments that are under way at once, each for as many days as pieces, and their common days."""
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    one = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day.alias("lo"), (day + F.col("l_quantity").cast("int")).alias("hi"))
    return intervals.overlap_totals(one, ["supplier"], "id", "lo", "hi").withColumnRenamed("common", "days")
