"""Panels of series: patterns, unions, quality and basis groups; facets, token counts, time and region codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.periods import TIME_CODES, converted, era_date, era_fiscal, region_of
from quillstone.operators import series
from quillstone.plans.adapters import SERIES, catalog, series_values, table
from quillstone.plans.catalog import query

WISHES = {"measure": ["count", "nothing"], "freq": ["a", "q"]}
FITS = "sc WHERE org = 'asia' AND prio = 'p1'"


def _expanded(spark, sf):
    return series.expanded(catalog(series_values(spark, sf)), "asia.orders.{measure}.{seg}-p1.{freq}", WISHES)


@query(f"WITH {SERIES} SELECT series_id, measure, seg, freq FROM {FITS} AND measure = 'count' AND freq IN ('a', 'q')")
def panel_pattern(spark, sf):
    return _expanded(spark, sf)[0]


@query("SELECT 'measure' AS dim, 'nothing' AS slug")
def panel_unknown_slugs(spark, sf):
    return _expanded(spark, sf)[1]


@query(f"""WITH {SERIES}, a AS (SELECT series_id, row_number() OVER (ORDER BY series_id DESC) AS place FROM {FITS} AND measure = 'count' AND freq = 'a'), b AS (SELECT series_id, row_number() OVER (ORDER BY series_id) AS place FROM {FITS} AND freq = 'a'),
    u AS (SELECT series_id, min(at) AS at FROM (SELECT series_id, place AS at FROM a UNION ALL SELECT series_id, 100000 + place FROM b) GROUP BY 1) SELECT series_id, row_number() OVER (ORDER BY at) AS place FROM u""".replace(" at)", " pos)").replace("AS at", "AS pos").replace("min(at)", "min(pos)").replace("BY at)", "BY pos)"))
def panel_union(spark, sf):
    fits = catalog(series_values(spark, sf)).filter("org = 'asia' AND prio = 'p1' AND freq = 'a'").select("series_id", "measure")
    place = lambda rows, order: rows.select("series_id", F.row_number().over(series.Window.orderBy(order)).alias("place"))
    return series.ordered_union([place(fits.filter("measure = 'count'"), F.desc("series_id")), place(fits, "series_id")])


@query(f"""WITH {SERIES}, s AS (SELECT series_id, freq, CASE WHEN measure = 'count' THEN '1997' ELSE '1999' END AS usable_from, CASE WHEN seg = 'all' THEN 'total' ELSE '' END AS caution FROM sc), g AS (SELECT freq, usable_from, caution, min(series_id) AS f, count(*) AS n FROM s GROUP BY 1, 2, 3)
    SELECT freq, usable_from, caution, 'q' || row_number() OVER (ORDER BY f) AS quality, n FROM g""")
def panel_quality(spark, sf):
    c = catalog(series_values(spark, sf)).select("series_id", "freq", F.when(F.col("measure") == "count", "1997").otherwise("1999").alias("usable_from"), F.when(F.col("seg") == "all", "total").otherwise("").alias("caution"))
    return series.quality_groups(c, ["freq", "usable_from", "caution"])


@query(f"WITH {SERIES} SELECT CASE measure WHEN 'count' THEN 'flow' ELSE 'end' END AS basis, count(*) AS n, true AS mixed FROM sc GROUP BY 1")
def panel_basis(spark, sf):
    c = catalog(series_values(spark, sf)).withColumn("basis", F.when(F.col("measure") == "count", "flow").otherwise("end"))
    return series.basis_groups(c, "basis")


@query(f"WITH {SERIES} SELECT org, NULL AS freq, CASE WHEN count(DISTINCT edition) = 1 THEN min(edition) END AS edition, count(*) AS n FROM (SELECT *, CASE WHEN org < 'b' THEN 'first' ELSE measure END AS edition FROM sc) GROUP BY 1")
def source_factoring(spark, sf):
    c = catalog(series_values(spark, sf)).withColumn("edition", F.when(F.col("org") < "b", "first").otherwise(F.col("measure")))
    return series.factored(c, "org", ["freq", "edition"])


@query(f"WITH {SERIES} SELECT * FROM (SELECT 'asia' AS token, count(*) FILTER (contains(series_id, 'asia')) AS n FROM sc UNION ALL SELECT 'building', count(*) FILTER (contains(series_id, 'building')) FROM sc UNION ALL SELECT 'nothing', 0)")
def search_token_hits(spark, sf):
    return series.token_hits(catalog(series_values(spark, sf)), ["asia", "building", "nothing"], ["series_id"])


@query(f"WITH {SERIES} SELECT series_id FROM sc WHERE org IN ('asia', 'europe') AND freq = 'q' AND (seg = 'building' OR prio = 'p1')")
def series_facets(spark, sf):
    c = catalog(series_values(spark, sf)).withColumn("tags", F.array("seg", "prio"))
    return series.faceted(c, ["building", "p1"], org=["asia", "europe"], freq="q", measure=None).select("series_id")


@query(f"""WITH {SERIES}, d AS (SELECT series_id, seg, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY year, sub)) AS d FROM sv WHERE freq = 'q' AND value > 0), g AS (SELECT series_id, seg, list_sort(list(d)) AS ds FROM d WHERE d IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8),
    m AS (SELECT *, ds[len(ds) // 2 + 1] AS m FROM g), x AS (SELECT series_id, seg, round(1.4826 * list_sort([abs(x - m) FOR x IN ds])[len(ds) // 2 + 1], 4) AS dispersion FROM m)
    SELECT c.series_id, p.series_id AS parent, c.dispersion, p.dispersion AS parent_dispersion, coalesce(c.dispersion >= 0.15 AND round(c.dispersion / nullif(p.dispersion, 0), 2) >= 2, false) AS volatile FROM x c JOIN x p ON p.series_id = replace(c.series_id, '.' || c.seg || '-', '.all-') WHERE c.seg <> 'all'""")
def dispersion_flags(spark, sf):
    v = series_values(spark, sf).filter("freq = 'q'")
    parent = F.replace("series_id", F.concat(F.lit("."), "seg", F.lit("-")), F.lit(".all-"))
    return series.volatile(series.dispersion(v), catalog(v).filter("seg <> 'all'").select("series_id", parent.alias("parent")))


CODES = [
    ("boj_gap_q", " 1983.1Q", "1983Q1"), ("boj_gap_q", "1983.5Q", None), ("boj_gap_h", "1983.2 : 1983.4Q", "FY1983H2"), ("esri_qe_quarter", "1994/ 1- 3.", "1994Q1"), ("esri_qe_quarter", "1994/10-12", "1994Q4"), ("esri_qe_quarter", "1994/2-4", None),
    ("esri_year_fy", "1994", "FY1994"), ("esri_year_a", "1994", "1994"), ("esri_year_a", "94", None), ("esri_year_paren", "令和6暦年末（2024）", "2024"), ("esri_year_paren_fy", "令和6年度（2024）", "FY2024"), ("esri_year_paren_fy", "令和6暦年（2024）", None),
    ("estat_hojin_fy", "19600", "FY1960"), ("estat_hojin_fq", "19542", "FY1954Q1"), ("estat_hojin_fq", "19541", "FY1953Q4"), ("estat_hojin_fq", "19545", None), ("estat_cpi_time", "2026000707", "2026-07"), ("estat_cpi_time", "2025100000", "FY2025"),
    ("estat_cpi_time", "2025000000", "2025"), ("estat_cpi_time", "2026000708", None), ("estat_quarter", "2002000103", "2002Q1"), ("estat_quarter", "2002000204", None), ("estat_yyyymm", "202407", "2024-07"), ("estat_yyyymm", "2024", "2024"), ("estat_roudou_time", "202407", "2024-07"), ("estat_roudou_time", "2024000707", "2024-07"),
]
_sql = lambda v: "NULL" if v is None else f"'{v}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}', {_sql(p)})" for s, c, p in CODES) + ") AS t(source, code, period)")
def time_codes(spark, sf):
    rows = spark.createDataFrame([(s, c) for s, c, _ in CODES], "source string, code string")
    period = F.coalesce(*(F.when(F.col("source") == s, converted(s, F.col("code"))) for s in TIME_CODES))
    return rows.select("source", "code", period.alias("period"))


@query("SELECT DISTINCT lpad(CAST(n_nationkey * 1000 AS VARCHAR), 5, '0') AS code, CASE WHEN n_nationkey = 0 THEN 'JP' ELSE lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS region FROM nation UNION ALL SELECT '13101', '13101' UNION ALL SELECT 'x', NULL")
def region_codes(spark, sf):
    codes = table(spark, sf, "nation").select(F.lpad((F.col("n_nationkey") * 1000).cast("string"), 5, F.lit("0")).alias("code")).distinct()
    codes = codes.union(spark.createDataFrame([("13101",), ("x",)], "code string"))
    return codes.select("code", region_of(F.col("code")).alias("region"))


ERA_TEXTS = [("令和8年7月31日", "2026-07-31", None), ("S49.9.24", "1974-09-24", None), ("H10.2.30", None, None), ("令和8年度", None, "FY2026"), ("平成 元 年度", None, "FY1989"), ("令和8", None, None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {_sql(d)}, {_sql(f)})" for t, d, f in ERA_TEXTS) + ") AS t(era, day, fiscal)")
def era_texts(spark, sf):
    rows = spark.createDataFrame([(t,) for t, _, _ in ERA_TEXTS], "era string")
    return rows.select("era", era_date(F.col("era")).alias("day"), era_fiscal(F.col("era")).alias("fiscal"))
