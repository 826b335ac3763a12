"""Screens over series of years of customers' facts, with two standards, lost statements and a line that changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import trend_screen as ts
from quillstone.operators.expr import Vocabulary
from quillstone.plans.adapters import CUSTOMER_FACTS, facts
from quillstone.plans.catalog import query
from quillstone.sources.shared import stored

WORDS = Vocabulary(frozenset({"sales", "revenue", "gross", "quantity", "per_unit", ts.TOP}), {"growth": "revenue[t] / revenue[t-1] - 1"}, frozenset())
CONDITIONS = [ts.TrendCondition("cagr", ts.TOP, least=-0.6), ts.TrendCondition("years_meeting", "growth", least=1, year_least=0.0), ts.TrendCondition("mean", "per_unit")]
SHARES = ts.Shares(frozenset({"per_unit"}), (("gross", "per_unit"),), "revenue", "quantity")
TOPS = ("sales", "gross")
FROM, TO = 1996 * 12 + 12, 2000 * 12 + 12


def filed(spark, sf):
    """Facts of customers: every fourth has another standard before 1997, every fifth no sales before 1998, every seventh no consolidated statements of 1998."""
    f, c, y = facts(spark, sf, "o_custkey"), F.col("company"), F.col("period")
    f = f.filter(~((c % 7 == 3) & (y == 1998) & (F.col("basis") == "consolidated")))
    per_unit = F.col("gross").cast("double") / F.col("quantity").cast("double")
    f = f.withColumns({"declared": F.lit("JP"), "standard": F.when((c % 4 == 0) & (y < 1997), "US").otherwise("JP"), "sales": F.when((c % 5 != 1) | (y >= 1998), F.col("revenue")), "per_unit": per_unit})
    return f.withColumn("period", y * 12 + 12)


FRAMES = f"""WITH {CUSTOMER_FACTS}, f AS (SELECT *, company % 4 = 0 AND period < 1997 AS us, CASE WHEN company % 5 <> 1 OR period >= 1998 THEN revenue END AS sales FROM facts WHERE NOT (company % 7 = 3 AND period = 1998 AND basis = 'consolidated')),
d AS (SELECT company, doc, max(period) AS own, max(CASE WHEN basis = 'consolidated' THEN period END) AS whole FROM f GROUP BY 1, 2),
l AS (SELECT company, max(CASE WHEN own <= 2000 THEN doc END) AS doc FROM d GROUP BY 1),
h AS (SELECT l.company, own, CASE WHEN own IS NULL THEN NULL WHEN whole = own THEN 'consolidated' ELSE 'non_consolidated' END AS basis FROM l LEFT JOIN d ON d.company = l.company AND d.doc = l.doc),
p AS (SELECT *, lag(period) OVER (PARTITION BY company ORDER BY period) AS before FROM (SELECT company, period, bool_or(basis = 'consolidated') AS c, bool_or(basis = 'non_consolidated') AS n FROM f GROUP BY 1, 2)),
x AS (SELECT h.company, h.own, h.basis, p.period, before, CASE WHEN basis = 'consolidated' THEN c ELSE n END AS has FROM h LEFT JOIN p ON p.company = h.company AND p.period BETWEEN 1996 AND 2000),
fr AS (SELECT company, basis, min(period) AS oldest, max(period) AS newest, CASE WHEN max(own) IS NULL OR count(period) = 0 THEN 'no_period_in_window' WHEN min(period) > 1996 OR max(period) < 2000 THEN 'insufficient_history' WHEN count(*) FILTER (period - before <> 1) > 0 THEN 'irregular_period'
    WHEN count(*) FILTER (has) = 0 THEN CASE WHEN basis = 'consolidated' THEN 'no_consolidated_statements' ELSE 'input_not_disclosed' END WHEN count(*) FILTER (has) < count(*) THEN 'basis_changed' END AS reason FROM x GROUP BY 1, 2)"""
JUDGED = f"""{FRAMES}, g AS (SELECT f.company, f.doc, f.period, f.us, f.sales, f.revenue, f.gross, f.quantity, fr.oldest, fr.newest, CAST(f.gross AS DOUBLE) / CAST(f.quantity AS DOUBLE) AS per_unit, lead(f.revenue) OVER o AS revenue_1, lead(f.us) OVER o AS us_1, lead(f.period) OVER o AS period_1
    FROM f JOIN fr ON fr.company = f.company AND fr.basis = f.basis AND fr.reason IS NULL WINDOW o AS (PARTITION BY f.company, f.doc, f.basis ORDER BY f.period DESC)),
e AS (SELECT company, doc, period, 0 AS i, CAST(sales AS DOUBLE) AS v, CASE WHEN us THEN 'standard_changed' WHEN sales IS NULL THEN 'top_line_changed' END AS r, NULL AS cnt FROM g WHERE period BETWEEN oldest AND newest
    UNION ALL SELECT company, doc, period, 1, CAST(revenue AS DOUBLE) / CAST(revenue_1 AS DOUBLE) - 1, CASE WHEN us THEN 'standard_changed' WHEN period_1 IS NULL THEN 'period_not_in_document' WHEN period_1 <> period - 1 THEN 'irregular_period' WHEN us_1 THEN 'standard_changed' WHEN revenue_1 <= 0 THEN 'nonpositive_denominator' END, NULL FROM g WHERE period BETWEEN oldest AND newest
    UNION ALL SELECT company, doc, period, 2, per_unit, CASE WHEN us THEN 'standard_changed' END, CASE WHEN NOT us THEN CAST(gross AS DOUBLE) / per_unit END FROM g WHERE period BETWEEN oldest AND newest),
b AS (SELECT * FROM (SELECT company, doc, period, i, CASE WHEN r IS NULL THEN v END AS v, r, cnt, row_number() OVER (PARTITION BY company, i, period ORDER BY r IS NULL DESC, coalesce(r <> 'period_not_in_document', true) DESC, doc DESC) AS rn FROM e) WHERE rn = 1),
q AS (SELECT *, max(CASE WHEN r IS NOT NULL THEN period END) OVER (PARTITION BY company, i) AS lost, max(period) OVER (PARTITION BY company, i) AS top, cnt / lag(cnt) OVER (PARTITION BY company, i ORDER BY period) AS ratio FROM b),
z AS (SELECT company, i, max(CASE WHEN period = lost THEN r END) AS why, max(lost) AS lost, max(top) AS top FROM q GROUP BY 1, 2),
k AS (SELECT q.company, q.i, count(*) AS n, arg_min(v, period) AS a, arg_max(v, period) AS b, avg(v) AS m, count(*) FILTER (v >= 0) AS meet, bool_or(coalesce(ratio >= 1.45 OR ratio <= 1 / 1.45, false)) AS jump, min(period) AS lo, max(period) AS hi FROM q WHERE lost IS NULL OR period > lost GROUP BY 1, 2),
j AS (SELECT z.company, z.i, CASE WHEN why IS NOT NULL AND NOT (why = 'period_not_in_document' AND lost < top) THEN CASE why WHEN 'period_not_in_document' THEN 'insufficient_history' ELSE why END WHEN jump THEN 'share_count_changed' WHEN z.i = 0 AND n < 2 THEN 'insufficient_history' WHEN z.i = 0 AND a <= 0 THEN 'nonpositive_start' WHEN z.i = 0 AND b < 0 THEN 'negative_end' END AS reason,
        CASE z.i WHEN 0 THEN pow(b / a, 1.0 / (n - 1)) - 1 WHEN 1 THEN meet ELSE m END AS v, lo, hi FROM z LEFT JOIN k ON k.company = z.company AND k.i = z.i
    UNION ALL SELECT company, i, reason, NULL, NULL, NULL FROM fr, (VALUES (0), (1), (2)) AS t(i) WHERE reason IS NOT NULL),
s AS (SELECT company, min(CASE WHEN reason IS NOT NULL OR (i = 0 AND v < -0.6) OR (i = 1 AND v < 1) THEN i END) AS stop FROM j GROUP BY 1)"""
NAMES = "['cagr:top_line', 'years_meeting:growth', 'mean:per_unit'][s.stop + 1]"


def _screened(spark, sf):
    """Facts, frames and the screened companies; each stored, as several branches read them."""
    f = stored(filed(spark, sf), "facts")
    frames = stored(ts.frame(f, FROM, TO), "frames")
    return f, frames, stored(ts.screened(ts.judged(f, frames, CONDITIONS, WORDS, True, TOPS, SHARES), CONDITIONS), "screened")


@query(f"{JUDGED} SELECT j.company, round(max(CASE WHEN i = 0 THEN v END), 6) AS cagr, CAST(max(CASE WHEN i = 1 THEN v END) AS BIGINT) AS years_meeting, round(max(CASE WHEN i = 2 THEN v END), 3) AS mean FROM j JOIN s ON s.company = j.company AND stop IS NULL GROUP BY 1")
def trend_screen_matched(spark, sf):
    out = ts.matched(_screened(spark, sf)[2], CONDITIONS)
    return out.select("company", F.round("v0", 6).alias("cagr"), F.col("v1").cast("long").alias("years_meeting"), F.round("v2", 3).alias("mean"))


@query(f"{JUDGED}, r AS (SELECT s.company, {NAMES} AS condition, reason FROM s JOIN j ON j.company = s.company AND j.i = s.stop AND reason IS NOT NULL) SELECT condition, reason, count(*) AS n, array_to_string(list_sort(list(company))[1:5], ',') AS examples FROM r GROUP BY 1, 2")
def trend_screen_excluded(spark, sf):
    return ts.excluded(_screened(spark, sf)[2], CONDITIONS)


# the mean is rounded in whole numbers: half up, as in Spark
@query(f"""{JUDGED}, c AS (SELECT s.company, s.stop FROM s JOIN j ON j.company = s.company AND j.i = s.stop AND reason = 'share_count_changed'), n AS (SELECT company, period, arg_max(quantity, doc * 2 + CASE WHEN basis = 'consolidated' THEN 0 ELSE 1 END) AS q FROM f GROUP BY 1, 2),
    r AS (SELECT * FROM (SELECT g.company, g.period, revenue AS v, us, row_number() OVER (PARTITION BY g.company, g.period ORDER BY NOT us DESC, doc DESC) AS rn FROM g JOIN c ON c.company = g.company WHERE period BETWEEN oldest AND newest) WHERE rn = 1)
    SELECT company, CAST(stop AS INTEGER) AS stop, CAST((s + 5 * n) // (10 * n) AS DOUBLE) / 1000 AS value, NULL AS why, CAST(a.q AS DOUBLE) AS from_issued, CAST(b.q AS DOUBLE) AS to_issued FROM (SELECT c.company, c.stop, CAST(round(CAST(sum(v) AS DOUBLE) * 10000) AS HUGEINT) AS s, count(*) AS n, min(r.period) AS lo, max(r.period) AS hi FROM c JOIN r ON r.company = c.company GROUP BY 1, 2) t
    LEFT JOIN n a USING (company) LEFT JOIN n b USING (company) WHERE a.period = lo AND b.period = hi""")
def trend_screen_comparable(spark, sf):
    f, frames, rows = _screened(spark, sf)
    out = ts.comparable(f, rows, frames, CONDITIONS, WORDS, True, SHARES)
    return out.select("company", "stop", F.round("value", 3).alias("value"), "why", F.col("from_issued").cast("double").alias("from_issued"), F.col("to_issued").cast("double").alias("to_issued"))
