"""Queries over bitemporal facts: lookups, screens and trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions.text import unit_of
from quillstone.operators import checks, curation, screen, trend
from quillstone.operators import facts as ops
from quillstone.operators.expr import Vocabulary
from quillstone.plans.adapters import CUSTOMER_FACTS, FACTS, ITEMS, facts, lines, table
from quillstone.plans.catalog import query

WORDS = Vocabulary(frozenset(ITEMS), {"growth": "revenue[t] / revenue[t-1] - 1", "margin": "revenue / gross", "margin_change": "margin[t] - margin[t-1]"}, frozenset({"employees"}))
r4 = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
LATEST = "SELECT *, max(doc) OVER (PARTITION BY company, basis, period) AS newest FROM facts"


@query(f"WITH {FACTS} SELECT company, basis, period, doc, round(CAST(revenue AS DOUBLE), 4) AS revenue FROM ({LATEST}) WHERE doc = newest")
def facts_latest(spark, sf):
    return ops.newest_by(facts(spark, sf), ["company", "basis", "period"], ["revenue"]).select("company", "basis", "period", "doc", r4("revenue"))


@query(f"WITH {FACTS}, k AS (SELECT * FROM facts WHERE doc <= 1998) SELECT company, basis, period, doc, round(CAST(revenue AS DOUBLE), 4) AS revenue FROM (SELECT *, max(doc) OVER (PARTITION BY company, basis, period) AS newest FROM k) WHERE doc = newest")
def facts_as_of(spark, sf):
    return ops.as_of(facts(spark, sf), 1998, ["company", "basis", "period"], ["revenue"]).select("company", "basis", "period", "doc", r4("revenue"))


@query(f"WITH {FACTS}, k AS (SELECT *, max(doc) OVER (PARTITION BY company, basis) AS newest FROM facts WHERE doc = period AND period BETWEEN 1996 AND 1999) SELECT company, basis, period, round(CAST(gross AS DOUBLE), 4) AS gross FROM k WHERE doc = newest")
def facts_in_window(spark, sf):
    return ops.in_window(facts(spark, sf), 1996, 1999).select("company", "basis", "period", r4("gross"))


@query(f"""WITH {FACTS}, n AS ({LATEST}) SELECT f.company, f.basis, f.period, f.doc, n.doc AS newest_doc, round(CAST(f.quantity - n.quantity AS DOUBLE), 4) AS diff
    FROM facts f JOIN n ON f.company = n.company AND f.basis = n.basis AND f.period = n.period AND n.doc = n.newest WHERE f.doc <> n.doc AND abs(f.quantity - n.quantity) > greatest(CASE WHEN f.doc % 2 = 0 THEN 10 ELSE 1 END, CASE WHEN n.doc % 2 = 0 THEN 10 ELSE 1 END)""")
def facts_restated(spark, sf):
    unit = unit_of(F.when(F.col("doc") % 2 == 0, -1).otherwise(0))  # even years are given in tens
    return ops.restated(facts(spark, sf), "quantity", unit).select("company", "basis", "period", "doc", "newest_doc", F.round((F.col("value") - F.col("newest_value")).cast("double"), 4).alias("diff"))


WIDE = """w AS (SELECT *, lead(revenue, 1) OVER o AS revenue_1, lead(period, 1) OVER o AS period_1, lead(gross, 1) OVER o AS gross_1, max(doc) OVER (PARTITION BY company, basis) AS newest, max(period) OVER (PARTITION BY company, basis, doc) AS top
    FROM facts WINDOW o AS (PARTITION BY company, doc, basis ORDER BY period DESC))"""
GROWTH = "CASE WHEN period_1 IS NULL THEN 'period_not_in_document' WHEN period_1 <> period - 1 THEN 'irregular_period' WHEN revenue_1 IS NULL THEN 'input_not_disclosed' WHEN revenue_1 <= 0 THEN 'nonpositive_denominator' END"
JUDGED = f"""j AS (SELECT company, basis, period, {GROWTH} AS why_growth, CASE WHEN {GROWTH} IS NULL THEN CAST(revenue AS DOUBLE) / CAST(revenue_1 AS DOUBLE) - 1 END AS c_growth,
    CASE WHEN gross IS NULL THEN 'input_not_disclosed' WHEN gross <= 0 THEN 'nonpositive_denominator' END AS why_margin, CASE WHEN gross > 0 THEN CAST(revenue AS DOUBLE) / CAST(gross AS DOUBLE) END AS c_margin
    FROM w WHERE doc = newest AND period = top)"""
GROWS = [screen.Condition("growth", "growth", least=-0.6)]
BOTH = [screen.Condition("growth", "growth", least=-0.7), screen.Condition("margin", "margin", least=0.94, most=0.96)]


@query(f"WITH {FACTS}, {WIDE}, {JUDGED} SELECT company, period, round(c_growth, 6) AS growth FROM j WHERE basis = 'consolidated' AND c_growth >= -0.6 ORDER BY c_growth DESC, company LIMIT 20")
def screen_growth(spark, sf):
    rows = screen.evaluated(facts(spark, sf).filter("basis = 'consolidated'"), GROWS, WORDS)
    return screen.ranked(rows, GROWS, "growth", limit=20).select("company", "period", F.round(F.col("c_growth").cast("double"), 6).alias("growth"))


@query(f"WITH {FACTS}, {WIDE}, {JUDGED} SELECT j.company, n_name AS industry, round(c_growth, 6) AS growth, round(c_margin, 6) AS margin FROM j JOIN supplier ON s_suppkey = company JOIN nation ON n_nationkey = s_nationkey WHERE basis = 'consolidated' AND n_regionkey IN (0, 1, 2) AND c_growth >= -0.7 AND c_margin BETWEEN 0.94 AND 0.96")
def screen_two_conditions(spark, sf):
    rows = screen.evaluated(facts(spark, sf).filter("basis = 'consolidated'"), BOTH, WORDS)
    nation = table(spark, sf, "nation").filter(F.col("n_regionkey").isin(0, 1, 2))
    industry = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("company"), F.col("n_name").alias("industry"))
    return screen.ranked(rows.join(industry, "company"), BOTH, "growth").select("company", "industry", F.round(F.col("c_growth").cast("double"), 6).alias("growth"), F.round(F.col("c_margin").cast("double"), 6).alias("margin"))


@query(f"""WITH {CUSTOMER_FACTS}, {WIDE}, {JUDGED}, e AS (SELECT company, 'growth' AS condition, why_growth AS reason FROM j UNION ALL SELECT company, 'margin', why_margin FROM j)
    SELECT condition, reason, count(*) AS n, array_to_string(list_sort(list(DISTINCT company))[1:5], ',') AS examples FROM e WHERE reason IS NOT NULL GROUP BY 1, 2""")
def screen_excluded_reasons(spark, sf):
    return screen.exclusions(screen.evaluated(facts(spark, sf, "o_custkey"), BOTH, WORDS), BOTH)


@query(f"WITH {CUSTOMER_FACTS}, t AS (SELECT company, basis, max(period) AS period FROM facts GROUP BY 1, 2) SELECT CASE WHEN (2001 * 12 + 6) - (period * 12 + 12) > 18 THEN 'stale_period' ELSE 'current' END AS status, count(*) AS n FROM t GROUP BY 1")
def screen_stale(spark, sf):
    top = facts(spark, sf, "o_custkey").groupBy("company", "basis").agg(F.max("period").alias("period"))
    return screen.stale(top, "2001-06").groupBy(F.coalesce("why_stale", F.lit("current")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT company, period, CASE WHEN bool_or(basis = 'consolidated') THEN 'consolidated' ELSE 'non_consolidated' END AS basis FROM facts WHERE doc = 2000 GROUP BY 1, 2")
def default_basis(spark, sf):
    return ops.default_basis(facts(spark, sf).filter("doc = 2000"), ["company", "period"])


@query(f"""WITH {CUSTOMER_FACTS}, {WIDE}, g AS (SELECT company, doc, period, {GROWTH} AS why, CASE WHEN {GROWTH} IS NULL THEN CAST(revenue AS DOUBLE) / CAST(revenue_1 AS DOUBLE) - 1 END AS v FROM w WHERE basis = 'consolidated')
    SELECT company, period, doc, round(v, 6) AS value, why AS reason FROM (SELECT *, row_number() OVER (PARTITION BY company, period ORDER BY v IS NOT NULL DESC, coalesce(why <> 'period_not_in_document', false) DESC, doc DESC) AS rn FROM g) WHERE rn = 1""")
def first_computable_doc(spark, sf):
    wide = ops.with_offsets(facts(spark, sf, "o_custkey").filter("basis = 'consolidated'"), ["revenue"], 1)
    reason = ops.first_reason((F.col("period_1").isNull(), "period_not_in_document"), (F.col("period_1") != F.col("period") - 1, "irregular_period"), (F.col("revenue_1") <= 0, "nonpositive_denominator"))
    rows = wide.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), F.col("revenue").cast("double") / F.col("revenue_1").cast("double") - 1))
    out = ops.first_computable(rows.withColumn("reason", F.col("reason")), ["company", "period"], "value", "reason")
    return out.select("company", "period", "doc", F.round("value", 6).alias("value"), "reason")


QUESTIONS = ["Supplier#000000001", "supplier#00000000", "7", "nobody", "#000000012", ""]


@query("""WITH q AS (SELECT unnest(['Supplier#000000001', 'supplier#00000000', '7', 'nobody', '#000000012', '']) AS query), k AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS code, lower(s_name) AS key FROM supplier),
    e AS (SELECT query, code, CASE WHEN lower(query) = lower('S' || code) THEN 1 WHEN query = code THEN 2 WHEN lower(query) = key THEN 3 WHEN length(query) > 0 AND contains(key, lower(query)) THEN 4 END AS tier FROM q, k),
    b AS (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM e WHERE tier IS NOT NULL), g AS (SELECT query, count(*) AS n, list_sort(list(code)) AS codes FROM (SELECT DISTINCT query, code FROM b WHERE tier = best) GROUP BY 1)
    SELECT q.query, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, coalesce(n, 0) AS n, coalesce(array_to_string(codes[1:20], ','), '') AS candidates FROM q LEFT JOIN g ON g.query = q.query""")
def company_resolve(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("sec_code"), F.lower("s_name").alias("key"))
    names = names.select(F.col("sec_code").alias("code"), "sec_code", "key")
    return ops.resolve(spark.createDataFrame([(q,) for q in QUESTIONS], "query string"), names)


@query(f"""WITH {CUSTOMER_FACTS}, req AS (SELECT c_custkey AS company, CAST(1995 + c_custkey % 9 AS INTEGER) AS period FROM customer), f AS (SELECT company, period, max_by(revenue, doc) AS revenue, max(doc) AS doc FROM facts WHERE basis = 'consolidated' GROUP BY 1, 2), c AS (SELECT company, min(period) AS lo, max(period) AS hi FROM f GROUP BY 1)
    SELECT r.company, r.period, doc, round(CAST(revenue AS DOUBLE), 4) AS value, CASE WHEN c.company IS NULL THEN 'unknown_company' WHEN revenue IS NOT NULL THEN NULL WHEN r.period > hi THEN 'not_published' WHEN r.period < lo THEN 'out_of_range' ELSE 'not_disclosed' END AS reason
    FROM req r LEFT JOIN c ON c.company = r.company LEFT JOIN f ON f.company = r.company AND f.period = r.period""")
def fact_lookup_reasons(spark, sf):
    req = table(spark, sf, "customer").select(F.col("c_custkey").alias("company"), (1995 + F.col("c_custkey") % 9).cast("int").alias("period"))
    f = ops.newest_by(facts(spark, sf, "o_custkey").filter("basis = 'consolidated'"), ["company", "period"], ["revenue"])
    ends = f.groupBy("company").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    out = req.join(ends, "company", "left").join(f, ["company", "period"], "left")
    reason = F.when(F.col("lo").isNull(), "unknown_company").when(F.col("revenue").isNotNull(), None).when(F.col("period") > F.col("hi"), "not_published").when(F.col("period") < F.col("lo"), "out_of_range").otherwise("not_disclosed")
    return out.select("company", "period", "doc", F.round(F.col("revenue").cast("double"), 4).alias("value"), reason.alias("reason"))


@query(f"WITH {FACTS} SELECT company, period, CASE WHEN max(CASE WHEN basis = 'consolidated' THEN revenue END) IS NOT NULL THEN 'revenue' ELSE 'gross' END AS item, round(coalesce(CAST(max(CASE WHEN basis = 'consolidated' THEN revenue END) AS DOUBLE), CAST(max(gross) AS DOUBLE)), 4) AS value FROM facts WHERE doc = 2000 GROUP BY 1, 2")
def screen_top_line(spark, sf):
    rows = facts(spark, sf).filter("doc = 2000")
    long = rows.select("company", "period", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.lit("revenue").alias("item"), F.when(F.col("basis") == "consolidated", F.col("revenue")).alias("value")), F.struct(F.lit(2).alias("p"), F.lit("gross").alias("item"), F.col("gross").cast("decimal(38,4)").alias("value")))).alias("e")).select("company", "period", "e.*")
    best = long.filter("value IS NOT NULL").groupBy("company", "period", "item").agg(F.min("p").alias("p"), F.max("value").alias("value"))
    return best.groupBy("company", "period").agg(F.min_by(F.struct("item", "value"), "p").alias("b")).select("company", "period", "b.item", F.round(F.col("b.value").cast("double"), 4).alias("value"))


YEARLY = "y AS (SELECT company, period, max_by(revenue, doc) AS value FROM facts WHERE basis = 'consolidated' GROUP BY 1, 2), s AS (SELECT *, lag(value) OVER o AS before, lag(period) OVER o AS pb FROM y WINDOW o AS (PARTITION BY company ORDER BY period))"
AGG = """a AS (SELECT company, count(*) AS years, arg_min(value, period) AS first, arg_max(value, period) AS last, max(period) AS top, CAST(sum(value) AS DOUBLE) / count(*) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (value BETWEEN 10000 AND 200000) AS years_meeting,
    coalesce(bool_or(period - pb <> 1), false) AS gaps, max(CASE WHEN before IS NULL OR value <= before THEN period END) AS nu, max(CASE WHEN before IS NULL OR value >= before THEN period END) AS nd FROM s GROUP BY 1)"""
WHY = "CASE WHEN gaps THEN 'irregular_period' WHEN years < 2 THEN 'insufficient_history' END"


def _trend(spark, sf, company="l_suppkey", **limits):
    y = ops.newest_by(facts(spark, sf, company).filter("basis = 'consolidated'"), ["company", "period"], ["revenue"]).withColumnRenamed("revenue", "value")
    return trend.aggregated(y, **limits)


@query(f"WITH {FACTS}, {YEARLY}, {AGG} SELECT company, round(CASE WHEN {WHY} IS NULL AND first > 0 AND last >= 0 THEN pow(CAST(last AS DOUBLE) / CAST(first AS DOUBLE), 1.0 / (years - 1)) - 1 END, 6) AS cagr FROM a")
def trend_cagr(spark, sf):
    return _trend(spark, sf).select("company", F.round("cagr", 6).alias("cagr"))


@query(f"WITH {CUSTOMER_FACTS}, {YEARLY}, {AGG} SELECT company, round(CASE WHEN {WHY} IS NULL THEN CAST(last - first AS DOUBLE) END, 4) AS change, round(CASE WHEN {WHY} IS NULL AND first > 0 THEN CAST(last AS DOUBLE) / CAST(first AS DOUBLE) END, 6) AS ratio FROM a")
def trend_change_ratio(spark, sf):
    return _trend(spark, sf, "o_custkey").select("company", F.round(F.col("change").cast("double"), 4).alias("change"), F.round("ratio", 6).alias("ratio"))


@query(f"WITH {CUSTOMER_FACTS}, {YEARLY}, {AGG} SELECT company, round(mean, 6) AS mean, round(CAST(least AS DOUBLE), 4) AS least, round(CAST(most AS DOUBLE), 4) AS most, years_meeting FROM a")
def trend_mean_min_max(spark, sf):
    return _trend(spark, sf, "o_custkey", least=10000, most=200000).select("company", F.round(F.col("mean").cast("double"), 6).alias("mean"), r4("least"), r4("most"), "years_meeting")


@query(f"WITH {FACTS}, {YEARLY}, {AGG} SELECT company, top - nu AS streak_up, top - nd AS streak_down FROM a")
def trend_streaks(spark, sf):
    return _trend(spark, sf).select("company", "streak_up", "streak_down")


@query(f"WITH {CUSTOMER_FACTS}, {YEARLY}, {AGG} SELECT coalesce({WHY}, CASE WHEN first <= 0 THEN 'nonpositive_start' WHEN last < 0 THEN 'negative_end' ELSE 'computed' END) AS reason, count(*) AS n FROM a GROUP BY 1")
def trend_excluded_reasons(spark, sf):
    return _trend(spark, sf, "o_custkey").groupBy(F.coalesce("why_cagr", F.lit("computed")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, {YEARLY} SELECT company, array_to_string(list(period ORDER BY period DESC), ',') AS periods, count(*) AS n FROM y GROUP BY 1")
def trend_compact(spark, sf):
    y = ops.newest_by(facts(spark, sf).filter("basis = 'consolidated'"), ["company", "period"], ["revenue"]).withColumnRenamed("revenue", "value")
    return trend.compact(y).select("company", F.array_join(F.transform("periods", lambda p: p.cast("string")), ",").alias("periods"), F.size("values").cast("long").alias("n"))


@query(f"""WITH {FACTS}, c AS (SELECT * FROM facts WHERE basis = 'consolidated'), r AS (SELECT n.company, o.doc AS old_doc, n.doc, unnest([CAST(n.revenue AS DOUBLE) / CAST(o.revenue AS DOUBLE), CAST(n.quantity AS DOUBLE) / CAST(o.quantity AS DOUBLE)]) AS r FROM c n JOIN c o ON n.company = o.company AND n.period = o.period AND o.doc = n.doc - 1)
    SELECT company, old_doc, doc, round(min(r), 6) AS lo, round(max(r), 6) AS hi, count(*) AS n, max(r) / min(r) < 1.02 AND abs(min(r) - 1) > 0.05 AS suspect FROM r GROUP BY 1, 2, 3""")
def split_detect(spark, sf):
    out = trend.split_suspects(facts(spark, sf).filter("basis = 'consolidated'"), ["revenue", "quantity"])
    return out.select("company", "old_doc", "doc", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", "suspect")


@query(f"""WITH {CUSTOMER_FACTS}, y AS (SELECT company, period, arg_max(revenue, doc) AS v1, arg_max(quantity, doc) AS v2 FROM facts WHERE basis = 'consolidated' GROUP BY 1, 2), r AS (SELECT company, period, CAST(v1 AS DOUBLE) / lag(CAST(v1 AS DOUBLE)) OVER o AS a, CAST(v2 AS DOUBLE) / lag(CAST(v2 AS DOUBLE)) OVER o AS b FROM y WINDOW o AS (PARTITION BY company ORDER BY period))
    SELECT company, period, CASE WHEN a >= 1.45 THEN 'up' ELSE 'down' END AS direction FROM r WHERE (a >= 1.45 AND b >= 1.45) OR (a <= 1 / 1.45 AND b <= 1 / 1.45)""")
def share_jump(spark, sf):
    y = ops.newest_by(facts(spark, sf, "o_custkey").filter("basis = 'consolidated'"), ["company", "period"], ["revenue", "quantity"])
    return trend.jumps(y, ["revenue", "quantity"])


@query(f"WITH {FACTS} SELECT count(*) AS n_rows, count(*) FILTER (abs(gross - revenue) > gross * 0.052) AS gaps FROM facts")
def identity_check(spark, sf):
    f = facts(spark, sf)
    gaps = checks.identity_gaps(f, F.col("gross"), F.col("revenue"), F.col("gross") * F.lit(0.052).cast("decimal(4,3)"))
    return f.agg(F.count("*").alias("n_rows")).crossJoin(gaps.agg(F.count("*").alias("gaps")))


@query("""WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS DECIMAL(12,2))) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(12,2)) AS v FROM orders)
    SELECT CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' WHEN abs(CAST(a.v AS DOUBLE) - 0.001 * CAST(b.v AS DOUBLE)) <= 100 THEN 'equal' ELSE 'different' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def reconcile_sources(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("value"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").cast("double").alias("value"))
    return checks.reconciled(a, b, ["k"], 0.001, 100).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT n_regionkey AS k, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderpriority || '/' || strftime(o_orderdate, '%m-%d') AS member FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ),
    s AS (SELECT k, period, list_sort(list(member)) AS now FROM m GROUP BY 1, 2), b AS (SELECT *, lag(now) OVER (PARTITION BY k ORDER BY period) AS before FROM s)
    SELECT k, period, array_to_string(list_filter(now, lambda x: NOT list_contains(before, x)), ';') AS added, array_to_string(list_filter(before, lambda x: NOT list_contains(now, x)), ';') AS removed FROM b WHERE before IS NOT NULL""")
def regroup_diff(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.col("n_regionkey").alias("k"), F.year("o_orderdate").alias("period"), F.concat("o_orderpriority", F.lit("/"), F.date_format("o_orderdate", "MM-dd")).alias("member"))
    out = checks.regrouped(rows, ["k"], "period", "member")
    return out.select("k", "period", F.array_join("added", ";").alias("added"), F.array_join("removed", ";").alias("removed"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2")
def population_report(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, 'old' AS v FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), n AS (SELECT o_orderkey, o_custkey, 'new' AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')
    SELECT v, count(*) AS n, count(DISTINCT o_custkey) AS docs FROM (SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n) GROUP BY 1""")
def upsert_by_doc(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    old, new = o.filter("o_orderdate < TIMESTAMP_NTZ '2000-01-01'").withColumn("v", F.lit("old")), o.filter("o_orderdate >= TIMESTAMP_NTZ '1999-01-01'").withColumn("v", F.lit("new"))
    return curation.upsert_by(old, new, "o_custkey").groupBy("v").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("docs"))


@query("""WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer), s AS (SELECT c_custkey + 10 AS c_custkey, c_name, c_mktsegment FROM customer)
    SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NULL THEN c.c_mktsegment WHEN c.c_mktsegment <> '' THEN c.c_mktsegment ELSE s.c_mktsegment END AS c_mktsegment, CASE WHEN s.c_custkey IS NULL THEN c.c_name ELSE s.c_name || '!' END AS c_name FROM c FULL JOIN s ON c.c_custkey = s.c_custkey""")
def upsert_sticky(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    old = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_name")
    new = c.select((F.col("c_custkey") + 10).alias("c_custkey"), "c_mktsegment", F.concat("c_name", F.lit("!")).alias("c_name"))
    return curation.upsert_sticky(old, new, "c_custkey", ["c_mktsegment"])


@query(f"WITH {FACTS} SELECT basis, count(*) AS n_rows, round(CAST(sum(revenue) AS DOUBLE), 2) AS revenue FROM facts GROUP BY 1")
def facts_by_basis(spark, sf):
    return facts(spark, sf).groupBy("basis").agg(F.count("*").alias("n_rows"), F.round(F.sum("revenue").cast("double"), 2).alias("revenue"))


@query("SELECT l_suppkey AS company, count(*) AS n, count(*) FILTER (period - pb > 1) AS gaps FROM (SELECT l_suppkey, period, lag(period) OVER (PARTITION BY l_suppkey ORDER BY period) AS pb FROM (SELECT DISTINCT l_suppkey, year(o_orderdate) AS period FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) GROUP BY 1")
def irregular_periods(spark, sf):
    p = lines(spark, sf).select("company", "period").distinct()
    before = F.lag("period").over(Window.partitionBy("company").orderBy("period"))
    return p.withColumn("b", before).groupBy("company").agg(F.count("*").alias("n"), F.count_if(F.col("period") - F.col("b") > 1).alias("gaps"))
