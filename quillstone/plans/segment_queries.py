"""Queries over segment figures and over the choice between several figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import checks, screen
from quillstone.operators import facts as ops
from quillstone.operators import segments as sg
from quillstone.plans.adapters import CUSTOMER_FACTS, FACTS, SEGMENTS, facts, segments, table
from quillstone.plans.catalog import query

KEYS = "company, member, period"


@query(f"""WITH {SEGMENTS}, req AS (SELECT s_suppkey AS company, CAST(1994 + s_suppkey % 10 AS INTEGER) AS period FROM supplier), fl AS (SELECT DISTINCT company, CAST(d AS INTEGER) AS doc, period FROM sg, (SELECT unnest(range(1990, 2012)) AS d) WHERE d BETWEEN sg.doc AND sg.doc + 2),
    b AS (SELECT company, period, max(CASE WHEN (company, doc) IN (SELECT (company, doc) FROM sg) THEN doc END) AS doc FROM fl GROUP BY 1, 2), r AS (SELECT req.*, b.doc, b.company IS NOT NULL AS covered FROM req LEFT JOIN b ON b.company = req.company AND b.period = req.period),
    f AS (SELECT r.*, sg.member, sg.value, count(sg.value) OVER (PARTITION BY r.company, r.period) AS n FROM r LEFT JOIN sg ON sg.company = r.company AND sg.period = r.period AND sg.doc = r.doc), w AS (SELECT *, CASE WHEN NOT covered THEN 'period_not_in_document' WHEN doc IS NULL THEN 'not_tagged' WHEN n = 0 THEN 'no_segment_figures' END AS reason FROM f)
    SELECT company, period, doc, member, value, reason FROM w WHERE reason IS NULL AND value IS NOT NULL UNION ALL SELECT DISTINCT company, period, doc, NULL, NULL, reason FROM w WHERE reason IS NOT NULL""")
def segment_lookup(spark, sf):
    s = segments(spark, sf)
    filings = s.select("company", "period", F.explode(F.sequence("doc", F.col("doc") + 2)).alias("doc")).distinct()
    req = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("company"), (1994 + F.col("s_suppkey") % 10).cast("int").alias("period"))
    return sg.lookup(req, filings, s)


@query(f"WITH {SEGMENTS} SELECT {KEYS}, max(doc) AS doc, arg_max(value, doc) AS value FROM sg WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def segment_range(spark, sf):
    return sg.range_of(segments(spark, sf))


@query(f"WITH {SEGMENTS}, n AS (SELECT {KEYS}, max(doc) AS newest_doc, arg_max(value, doc) AS newest_value FROM sg WHERE value IS NOT NULL GROUP BY 1, 2, 3) SELECT {KEYS}, doc, value, newest_doc, newest_value FROM sg JOIN n USING ({KEYS}) WHERE doc <> newest_doc AND value <> newest_value")
def segment_restated(spark, sf):
    return sg.restated_segments(segments(spark, sf)).select("company", "member", "period", "doc", "value", "newest_doc", "newest_value")


@query(f"""WITH {SEGMENTS}, s AS (SELECT company, period, list_sort(list(DISTINCT member)) AS now FROM sg GROUP BY 1, 2), b AS (SELECT *, lag(now) OVER (PARTITION BY company ORDER BY period) AS before FROM s)
    SELECT company, period, array_to_string(list_filter(now, lambda x: NOT list_contains(before, x)), ',') AS added, array_to_string(list_filter(before, lambda x: NOT list_contains(now, x)), ',') AS removed FROM b WHERE before IS NOT NULL""")
def segment_regrouped(spark, sf):
    out = checks.regrouped(segments(spark, sf), ["company"], "period", "member")
    return out.select("company", "period", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(f"WITH {SEGMENTS} SELECT CASE member WHEN '1-URGENT' THEN 'total' WHEN '2-HIGH' THEN 'adjustment' ELSE 'reportable' END AS kind, count(*) AS n, count(value) AS with_value FROM sg GROUP BY 1")
def segment_kinds(spark, sf):
    kind = sg.kind_of(F.col("member"), {"1-URGENT": "total", "2-HIGH": "adjustment"})
    return segments(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("value").alias("with_value"))


@query("""WITH r AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus AS standard, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3), d AS (SELECT o_custkey AS company, arg_max(o_orderstatus, o_orderkey) AS declared FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    g AS (SELECT r.company, period, count(*) AS n, min(standard) AS one, bool_or(standard = declared) AS own, any_value(declared) AS declared, list_sort(list(standard)) AS l FROM r LEFT JOIN d ON d.company = r.company GROUP BY 1, 2), p AS (SELECT *, CASE WHEN n = 1 THEN one WHEN own THEN declared END AS standard FROM g)
    SELECT p.company, p.period, CASE WHEN p.standard IS NULL THEN 'ambiguous' ELSE 'found' END AS status, p.standard, r.value, array_to_string(list_filter(l, lambda x: p.standard IS NULL OR x <> p.standard), ',') AS others FROM p LEFT JOIN r ON r.company = p.company AND r.period = p.period AND r.standard = p.standard""")
def standard_pick(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("standard")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("value"))
    declared = o.filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("company")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("standard"))
    return sg.by_standard(rows, ["company", "period"], declared)


THIN = "thin AS (SELECT company, doc, period, basis, CASE WHEN company % 3 <> 0 THEN revenue END AS revenue, CASE WHEN period % 2 = 0 THEN gross END AS gross, quantity, tax FROM facts WHERE basis = 'consolidated')"


def _thin(spark, sf):
    """Facts of which some are not disclosed."""
    f = facts(spark, sf, "o_custkey").filter("basis = 'consolidated'")
    return f.withColumn("revenue", F.when(F.col("company") % 3 != 0, F.col("revenue"))).withColumn("gross", F.when(F.col("period") % 2 == 0, F.col("gross")))


@query(f"WITH {CUSTOMER_FACTS}, {THIN} SELECT company, doc, period, CASE WHEN revenue IS NULL THEN CASE WHEN gross IS NOT NULL THEN 'gross,quantity' ELSE 'quantity' END END AS siblings, CAST(tax AS DOUBLE) AS companion FROM thin WHERE doc = period")
def sibling_items(spark, sf):
    """What else is disclosed where revenue is not, and the tax that goes with revenue."""
    rows = _thin(spark, sf).filter("doc = period")
    return rows.select("company", "doc", "period", F.array_join(sg.siblings(["revenue", "gross", "quantity"], "revenue"), ",").alias("siblings"), sg.companion("revenue", {"revenue": "tax"}).cast("double").alias("companion"))


@query(f"""WITH {CUSTOMER_FACTS}, {THIN}, w AS (SELECT *, lead(revenue) OVER o AS r1, lead(gross) OVER o AS g1 FROM thin WINDOW o AS (PARTITION BY company, doc, basis ORDER BY period DESC))
    SELECT company, doc, period, CASE WHEN revenue IS NOT NULL AND r1 IS NOT NULL THEN 'revenue' WHEN gross IS NOT NULL AND g1 IS NOT NULL THEN 'gross' END AS item, CASE WHEN (revenue IS NOT NULL AND r1 IS NOT NULL) OR (gross IS NOT NULL AND g1 IS NOT NULL) THEN NULL WHEN revenue IS NOT NULL OR gross IS NOT NULL THEN 'item_changes' ELSE 'input_not_disclosed' END AS reason FROM w""")
def top_line_fixed(spark, sf):
    item, reason = sg.top_line(["revenue", "gross"], 1)
    return ops.with_offsets(_thin(spark, sf), ["revenue", "gross"], 1).select("company", "doc", "period", item.alias("item"), reason.alias("reason"))


@query(f"WITH {FACTS} SELECT company, doc, basis, period, round(CASE WHEN basis = 'consolidated' THEN CAST(revenue AS DOUBLE) ELSE CAST(gross AS DOUBLE) END, 4) AS bottom_line FROM facts WHERE doc = period")
def bottom_lines(spark, sf):
    f = facts(spark, sf).filter("doc = period")
    value = sg.bottom_line(F.col("basis"), F.col("revenue").cast("decimal(38,4)"), F.col("gross").cast("decimal(38,4)"))
    return f.select("company", "doc", "basis", "period", F.round(value.cast("double"), 4).alias("bottom_line"))


@query(f"WITH {CUSTOMER_FACTS}, {THIN} SELECT 'revenue' AS item, count(*) - count(revenue) AS n FROM thin UNION ALL SELECT 'gross', count(*) - count(gross) FROM thin")
def unavailable_inputs(spark, sf):
    return screen.unavailable(_thin(spark, sf), ["revenue", "gross", "quantity"])
