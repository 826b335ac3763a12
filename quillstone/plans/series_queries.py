"""Queries over the series catalogue and its values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions.periods import era_year, matches, parsed, shifted
from quillstone.operators import checks, series
from quillstone.plans.adapters import SERIES, catalog, series_values, table
from quillstone.plans.catalog import query
from quillstone.sources.formats import cube, unpivoted

REQUESTS = [
    (1, "asia.orders.count.all-all.a", "1998", "ALL"), (2, "asia.orders.count.all-all.a", "2050", "ALL"), (3, "asia.orders.count.all-all.a", "1900", "ALL"), (4, "asia.orders.count.all-all.a", "1998Q1", "ALL"),
    (5, "asia.orders.count.all-all.q", "1998Q2", "ALL"), (6, "asia.orders.count.all-all.m", "1998-13", "ALL"), (7, "nowhere.orders.count.all-all.a", "1998", "ALL"), (8, "asia.orders.value.all-p1.m", "1998-05", "13"),
    (9, "europe.orders.value.building-p1.m", "1999-02", "ALL"), (10, "africa.orders.count.machinery-p5.q", "2000Q4", "ALL"),
]
REQ = "req AS (SELECT * FROM (VALUES " + ", ".join(map(str, REQUESTS)) + ") AS t(request, series_id, period, region))"
FITS = r"""CASE e.freq WHEN 'a' THEN regexp_full_match(r.period, '\d{4}') WHEN 'q' THEN regexp_full_match(r.period, '\d{4}Q[1-4]') ELSE regexp_full_match(r.period, '\d{4}-(0[1-9]|1[0-2])') END"""
AT = r"""CAST(substr(r.period, 1, 4) AS INTEGER) * 100 + CASE e.freq WHEN 'a' THEN 0 WHEN 'q' THEN CAST(substr(r.period, 6, 1) AS INTEGER) ELSE CAST(substr(r.period, 6, 2) AS INTEGER) END"""


@query(f"""WITH {SERIES}, {REQ}, e AS (SELECT series_id, any_value(freq) AS freq, min(year * 100 + sub) AS lo, max(year * 100 + sub) AS hi FROM sv GROUP BY 1)
    SELECT r.request, r.series_id, r.period, r.region, v.value, CASE WHEN e.series_id IS NULL THEN 'unknown_series' WHEN NOT ({FITS}) THEN 'period_format' WHEN r.region <> 'ALL' THEN 'region_not_available' WHEN v.value IS NOT NULL THEN NULL WHEN {AT} > hi THEN 'not_published' WHEN {AT} < lo THEN 'out_of_range' ELSE 'missing' END AS reason
    FROM req r LEFT JOIN e ON e.series_id = r.series_id LEFT JOIN sv v ON v.series_id = r.series_id AND v.period = r.period AND v.region = r.region""")
def series_point_lookup(spark, sf):
    v = series_values(spark, sf)
    req = spark.createDataFrame(REQUESTS, "request int, series_id string, period string, region string")
    return series.point_lookup(req, catalog(v).withColumn("status", F.lit("active")), v)


RANGES = [(1, "asia.orders.count.all-all.q", "1996Q3", "1998Q2"), (2, "europe.orders.value.building-all.m", "1999-11", "2000-03"), (3, "africa.orders.count.all-all.a", "1995", "2001"), (4, "asia.orders.count.all-all.m", "1995-01", "2001-12")]


@query(f"""WITH {SERIES}, req AS (SELECT * FROM (VALUES {", ".join(map(str, RANGES))}) AS t(request, series_id, lo, hi)), h AS (SELECT request, r.series_id, period, value, count(*) OVER (PARTITION BY request) AS n FROM req r JOIN sv ON sv.series_id = r.series_id AND period BETWEEN lo AND hi)
    SELECT request, series_id, period, value, NULL AS reason FROM h WHERE n <= 60 UNION ALL SELECT DISTINCT request, series_id, NULL, NULL, 'range_too_wide' FROM h WHERE n > 60""")
def series_range_lookup(spark, sf):
    return series.range_lookup(spark.createDataFrame(RANGES, "request int, series_id string, lo string, hi string"), series_values(spark, sf), 60)


@query(f"WITH {SERIES} SELECT org || '.' || seg AS series, max(value) FILTER (period = '1997') AS y1997, max(value) FILTER (period = '1998') AS y1998, max(value) FILTER (period = '1999') AS y1999 FROM sv WHERE measure = 'count' AND freq = 'a' AND prio = 'all' GROUP BY 1")
def series_panel(spark, sf):
    v = series_values(spark, sf).filter("measure = 'count' AND freq = 'a' AND prio = 'all'").withColumn("series", F.concat_ws(".", "org", "seg"))
    return v.groupBy("series").pivot("period", ["1997", "1998", "1999"]).agg(F.max("value")).withColumnsRenamed({"1997": "y1997", "1998": "y1998", "1999": "y1999"})


@query(f"""WITH {SERIES}, s AS (SELECT series_id, CASE WHEN seg <> 'all' THEN 1 ELSE 0 END + CASE WHEN prio <> 'all' THEN 1 ELSE 0 END AS specificity, CASE WHEN contains(series_id, 'asia') AND contains(series_id, 'value') THEN 0 ELSE 1 END AS strength FROM sc WHERE contains(series_id || ' ' || CASE freq WHEN 'a' THEN 'annual' WHEN 'q' THEN 'quarterly' ELSE 'monthly' END, 'asia') AND contains(series_id, 'value'))
    SELECT series_id, specificity, strength FROM s ORDER BY specificity, strength, series_id LIMIT 25""")
def series_search(spark, sf):
    c = catalog(series_values(spark, sf)).withColumns({"specificity": (F.col("seg") != "all").cast("int") + (F.col("prio") != "all").cast("int"), "notes": F.when(F.col("freq") == "a", "annual").when(F.col("freq") == "q", "quarterly").otherwise("monthly")})
    return series.search(c, ["asia", "value"], ["series_id"], ["notes"]).select("series_id", "specificity", "strength").limit(25)


@query(f"""WITH {SERIES}, p AS (SELECT org, measure, min(year) AS first_year, max(year) AS last_year FROM sv GROUP BY 1, 2)
    SELECT sc.org, sc.measure, count(*) AS series_count, array_to_string(list_sort(list(DISTINCT freq)), ',') AS freqs, array_to_string(list_sort(list(series_id))[1:4], ',') AS examples, any_value(first_year) AS first_year, any_value(last_year) AS last_year FROM sc JOIN p ON p.org = sc.org AND p.measure = sc.measure GROUP BY 1, 2""")
def series_catalog(spark, sf):
    v = series_values(spark, sf)
    one = v.groupBy("series_id", "org", "measure", "freq").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    first = F.row_number().over(Window.partitionBy("org", "measure").orderBy("series_id"))
    some = one.withColumn("n", first).filter("n <= 4").groupBy("org", "measure").agg(F.array_join(F.sort_array(F.collect_list("series_id")), ",").alias("examples"))
    out = one.groupBy("org", "measure").agg(F.count("*").alias("series_count"), F.array_join(F.sort_array(F.collect_set("freq")), ",").alias("freqs"), F.min("lo").alias("first_year"), F.max("hi").alias("last_year"))
    return out.join(some, ["org", "measure"]).orderBy("org", "measure")


@query(f"WITH {SERIES} SELECT org, count(*) AS series_count, count(*) FILTER (n > 60) AS with_values FROM (SELECT org, series_id, count(*) AS n FROM sv GROUP BY 1, 2) GROUP BY 1")
def series_sources(spark, sf):
    return series_values(spark, sf).groupBy("org", "series_id").agg(F.count("*").alias("n")).groupBy("org").agg(F.count("*").alias("series_count"), F.count_if(F.col("n") > 60).alias("with_values"))


@query(f"""WITH {SERIES}, s AS (SELECT *, count(*) OVER (PARTITION BY org, measure, freq) AS n FROM sc WHERE seg <> 'all' AND prio <> 'all' AND (org <> 'asia' OR seg = 'building' AND prio < 'p3'))
    SELECT series_id, 1 AS members, 'row' AS kind FROM s WHERE n <= 3 UNION ALL SELECT min(series_id), count(*), 'card' FROM s WHERE n > 3 GROUP BY org, measure, freq""")
def series_family_collapse(spark, sf):
    rows = catalog(series_values(spark, sf)).filter("seg <> 'all' AND prio <> 'all' AND (org <> 'asia' OR seg = 'building' AND prio < 'p3')")
    return series.collapsed(rows, ["org", "measure", "freq"], 3)


@query(f"WITH {SERIES} SELECT org, measure, seg, prio, arg_min(freq, CASE freq WHEN 'm' THEN 0 WHEN 'q' THEN 1 ELSE 2 END) AS freq FROM sc GROUP BY 1, 2, 3, 4")
def series_finest_freq(spark, sf):
    return series.finest(catalog(series_values(spark, sf)), ["org", "measure", "seg", "prio"], {"m": 0, "q": 1, "a": 2}).select("org", "measure", "seg", "prio", "freq")


@query(f"WITH {SERIES}, s AS (SELECT org, seg, array_to_string(list_sort(list(DISTINCT prio)), ',') AS others FROM sc WHERE measure = 'count' AND freq = 'm' AND (seg <> 'building' OR prio <> 'p3') GROUP BY 1, 2) SELECT org, others, array_to_string(list_sort(list(seg)), ',') AS \"values\", count(*) AS n FROM s GROUP BY 1, 2")
def series_coverage(spark, sf):
    c = catalog(series_values(spark, sf)).filter("measure = 'count' AND freq = 'm' AND (seg <> 'building' OR prio <> 'p3')")
    return series.coverage(c, "seg", "prio", ["org"])


@query(f"WITH {SERIES} SELECT measure, freq, count(*) AS n, 'asia' AS org FROM sc WHERE org = 'asia' AND NOT (seg = 'building' AND prio = 'p3') GROUP BY 1, 2")
def series_diagnose(spark, sf):
    parts = F.split("series_id", r"\.")
    c = catalog(series_values(spark, sf)).select("series_id").withColumns({"org": parts[0], "measure": parts[2], "dims": F.split(parts[3], "-"), "freq": parts[4]})
    return c.filter((F.col("org") == "asia") & ~((F.col("dims")[0] == "building") & (F.col("dims")[1] == "p3"))).groupBy("measure", "freq", "org").agg(F.count("*").alias("n"))


BREAKS = [("count", "1997", "renamed"), ("value", "1999", "rebased"), ("value", "2003", "later")]


@query(f"""WITH {SERIES}, b AS (SELECT * FROM (VALUES {", ".join(map(str, BREAKS))}) AS t(measure, break_period, note)), r AS (SELECT series_id, measure, min(period) AS lo, max(period) AS hi FROM sv WHERE freq = 'a' GROUP BY 1, 2)
    SELECT break_period, note, count(*) AS n FROM r JOIN b ON b.measure = r.measure AND lo < break_period AND break_period <= hi GROUP BY 1, 2""")
def breaks_in_range(spark, sf):
    req = series_values(spark, sf).filter("freq = 'a'").groupBy("series_id", "measure").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    return series.break_hits(req, spark.createDataFrame(BREAKS, "measure string, break_period string, note string")).groupBy("break_period", "note").agg(F.count("*").alias("n"))


@query(f"""WITH {SERIES}, d AS (SELECT series_id, region, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY year, sub)) AS d FROM sv WHERE freq = 'q' AND value > 0), g AS (SELECT series_id, region, list_sort(list(d)) AS ds FROM d WHERE d IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8),
    m AS (SELECT *, ds[len(ds) // 2 + 1] AS m FROM g) SELECT series_id, region, len(ds) AS n, round(1.4826 * list_sort([abs(x - m) FOR x IN ds])[len(ds) // 2 + 1], 4) AS dispersion FROM m""")
def dispersion_mad(spark, sf):
    return series.dispersion(series_values(spark, sf).filter("freq = 'q'"))


@query(f"""WITH {SERIES}, v AS (SELECT org || measure || freq AS k, org, measure, freq, seg, year * 100 + sub AS period, value FROM sv WHERE freq <> 'm' AND prio = 'all'),
    c AS (SELECT k, period, sum(value) AS s, count(*) AS n FROM v WHERE seg <> 'all' GROUP BY 1, 2), span AS (SELECT k, seg, min(period) AS lo, max(period) AS hi FROM v WHERE seg <> 'all' GROUP BY 1, 2),
    p AS (SELECT v.*, (SELECT count(*) FROM span WHERE span.k = v.k AND v.period BETWEEN lo AND hi) AS due FROM v WHERE seg = 'all'),
    o AS (SELECT p.*, coalesce(n, 0) >= due AND abs(coalesce(s, 0) - value) <= greatest(1, 1e-6 * abs(value)) AS ok FROM p LEFT JOIN c ON c.k = p.k AND c.period = p.period)
    SELECT org, measure, freq, period, ok, (SELECT min(x.period) FROM o x WHERE x.k = o.k AND NOT EXISTS (SELECT 1 FROM o y WHERE y.k = x.k AND y.period >= x.period AND NOT y.ok)) AS consistent_from FROM o""")
def sum_consistency(spark, sf):
    v = series_values(spark, sf).filter("freq <> 'm' AND prio = 'all'").withColumn("period", F.col("year") * 100 + F.col("sub"))
    children = v.filter("seg <> 'all'").select("org", "measure", "freq", "period", F.col("seg").alias("child"), "value")
    return checks.sum_check(children, v.filter("seg = 'all'").select("org", "measure", "freq", "period", "value"), ["org", "measure", "freq"], "period").select("org", "measure", "freq", "period", "ok", "consistent_from")


PERIODS = ["1998", "FY2020", "2021Q3", "FY2021Q4", "FY2021H1", "2020-12", "2020-13", "2024-02-28", "x", ""]
EXPECTED = [("1998", "a", 1998, 0, "2001"), ("FY2020", "fy", 2020, 0, "FY2023"), ("2021Q3", "q", 2021, 3, "2022Q2"), ("FY2021Q4", "fq", 2021, 4, "FY2022Q3"), ("FY2021H1", "h", 2021, 1, "FY2022H2"), ("2020-12", "m", 2020, 12, "2021-03"), ("2024-02-28", "d", 2024, 228, "2024-03-02")]


@query("SELECT * FROM (VALUES " + ", ".join(map(str, EXPECTED)) + ", ('2020-13', NULL, NULL, NULL, NULL), ('x', NULL, NULL, NULL, NULL), ('', NULL, NULL, NULL, NULL)) AS t(period, freq, year, sub, later)")
def period_shift(spark, sf):
    rows = spark.createDataFrame([(p,) for p in PERIODS], "period string")
    p = parsed(F.col("period"))
    return rows.select("period", p["freq"].alias("freq"), p["year"].alias("year"), p["sub"].alias("sub"), shifted(F.col("period"), F.lit(3)).alias("later"))


@query("SELECT * FROM (VALUES ('令和8年度', 2026), ('平成元年度', 1989), ('S60', 1985), ('Ｈ元', 1989), ('昭和 42', 1967), ('明日', NULL), ('令和8年', NULL)) AS t(era, year)")
def era_years(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ["令和8年度", "平成元年度", "S60", "Ｈ元", "昭和 42", "明日", "令和8年"]], "era string")
    return rows.select("era", era_year(F.col("era")).alias("year"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1")
def period_convert(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    return o.filter(matches(F.col("period"), F.lit("m"))).groupBy("period").agg(F.count("*").alias("n"))


CUBE = {"id": ["geo", "time"], "size": [2, 3], "dimension": {"geo": {"category": {"index": {"DE": 0, "FR": 1}}}, "time": {"category": {"index": ["2020", "2021", "2022"]}}}, "value": {"0": 1.5, "2": 3.0, "4": 5.5}}


@query("SELECT * FROM (VALUES ('DE', '2020', 1.5::DOUBLE), ('DE', '2022', 3.0), ('FR', '2021', 5.5)) AS t(geo, \"time\", value)")
def cube_unpack(spark, sf):
    return cube(spark, CUBE)


@query("SELECT r_name, period, n FROM (SELECT r_name, count(*) FILTER (year(o_orderdate) = 1997) AS y1997, count(*) FILTER (year(o_orderdate) = 1998) AS y1998 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) UNPIVOT (n FOR period IN (y1997, y1998))")
def wide_unpivot(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = o.groupBy("r_name").agg(F.count_if(F.year("o_orderdate") == 1997).alias("y1997"), F.count_if(F.year("o_orderdate") == 1998).alias("y1998"))
    return unpivoted(wide, ["r_name"], value="n")


@query("""WITH m AS (SELECT month(o_orderdate) AS month, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT *, CASE WHEN month = 1 THEN CAST(year AS VARCHAR) END AS label FROM m)
    SELECT year * 100 + month AS at, n, last_value(label IGNORE NULLS) OVER (ORDER BY year, month ROWS UNBOUNDED PRECEDING) AS carried FROM l""")
def carry_forward(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    rows = m.select((F.col("year") * 100 + F.col("month")).alias("at"), "n", F.when(F.col("month") == 1, F.col("year").cast("string")).alias("label"), F.lit(1).alias("sheet"))
    return rows.select("at", "n", checks.carried(rows, ["sheet"], "at", "label").alias("carried"))


@query(f"WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY year DESC, sub DESC) AS rn FROM sv) SELECT series_id, period, value FROM r WHERE rn = 1")
def series_latest(spark, sf):
    return series_values(spark, sf).groupBy("series_id").agg(F.max_by(F.struct("period", "value"), F.struct("year", "sub")).alias("s")).select("series_id", "s.period", "s.value")


@query(f"WITH {SERIES}, q AS (SELECT series_id, org, seg, sum(value) AS total FROM sv WHERE measure = 'count' AND freq = 'a' AND prio = 'all' AND seg <> 'all' GROUP BY 1, 2, 3) SELECT org, seg, total, rank() OVER (PARTITION BY org ORDER BY total DESC) AS place FROM q")
def series_ranking(spark, sf):
    q = series_values(spark, sf).filter("measure = 'count' AND freq = 'a' AND prio = 'all' AND seg <> 'all'").groupBy("org", "seg").agg(F.sum("value").alias("total"))
    return q.withColumn("place", F.rank().over(Window.partitionBy("org").orderBy(F.col("total").desc())))
