"""Sheets made from the orders as offices print them, and what the layouts read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import layouts as lo
from quillstone.plans.adapters import table
from quillstone.plans.catalog import query
from quillstone.sources.shared import dealt, stored

SECTIONS = (("貸借対照表", "BS"), ("行政コスト計算書", "PL"), ("資金収支計算書", "CF"))
STATES, QUARTERS, BANDS = ("F", "O", "P"), ("Q1", "Q2", "Q3", "Q4"), ("B0", "B1", "B2", "B3", "B4")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LAYOUT = lo.Statements(SECTIONS, {"Q1": "R0", "Q2": "R1", "Q3": "R2", "Q4": "R3"}, BANDS)
HEIGHT, START = 80, 6
#: Orders in a task that makes cells of them.
ORDERS = 100_000


def _index(values, column):
    return F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int") - 1


def _orders(spark, sf):
    """Orders with a sheet for each customer, their year, quarter and band of price."""
    band = F.concat(F.lit("B"), F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("string"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("sheet"), "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("quarter"), band.alias("band"))
    return dealt(o, "sheet", each=ORDERS)


def _cells(rows, sheet, *cells):
    """Cells of (row, col, text) for every row; those without a text are none."""
    whole = lambda c: (c if hasattr(c, "alias") else F.lit(c)).cast("int")
    text = lambda t: (t if hasattr(t, "alias") else F.lit(t)).cast("string")
    each = F.array(*(F.struct(whole(r).alias("row"), whole(c).alias("col"), text(t).alias("text")) for r, c, t in cells))
    return rows.select(sheet.alias("sheet"), F.explode(each).alias("c")).select("sheet", "c.*").filter("text IS NOT NULL")


def _stored(cells):
    """cells, made once and dealt by sheet, as all that reads them goes by sheet."""
    return dealt(stored(cells, "cells"), "sheet")


def statement_sheets(spark, sf):
    """A sheet a customer: three sections by state, in each a total, years and, indented, priorities; columns are quarters by bands.

    The third section has two rows of one name; a customer whose number ends in 7 has other heads in the second section.
    Priority 4 is printed in halves. Figures stand behind the end mark, too.
    """
    o = _orders(spark, sf).groupBy("sheet", "o_orderstatus", "year", "o_orderpriority", "quarter", "band").agg(F.count("*").alias("n"))
    o = o.withColumns({"base": START + HEIGHT * _index(STATES, "o_orderstatus"), "col": 7 + 5 * _index(QUARTERS, "quarter") + _index(BANDS, "band"), "at": _index(PRIORITIES, "o_orderpriority")})
    year_row, name = F.col("base") + 4 + 6 * (F.col("year") - 1992), F.col("sheet")
    halves = F.when(F.col("at") == 3, (F.col("n") / 2).cast("string")).otherwise(F.col("n").cast("string"))
    leaves = _cells(o, name, (year_row + 1 + F.col("at"), 3, F.col("o_orderpriority")), (year_row + 1 + F.col("at"), F.col("col"), halves)).distinct()
    years = _cells(o.groupBy("sheet", "base", "year", "col").agg(F.sum("n").alias("n")), name, (year_row, 2, F.concat("year", F.lit(" 年"))), (year_row, F.col("col"), F.format_number("n", 0))).distinct()
    totals = _cells(o.groupBy("sheet", "base", "col").agg(F.sum("n").alias("n")), name, (F.col("base") + 3, 1, "合計"), (F.col("base") + 3, F.col("col"), F.col("n"))).distinct()
    sheets = o.select("sheet").distinct()
    fixed, end = [], START + HEIGHT * len(STATES)
    for i, (title, _) in enumerate(SECTIONS):
        at = START + HEIGHT * i
        fixed += [(at, 1, f"{title}（会計別）"), (at + 2, 2, lo.HEAD)]
        for c in range(20):
            text = BANDS[c % 5]
            fixed += [(at + 1, 7 + c, F.when(name.endswith("7") & (c == 3), "別").otherwise(text) if i == 1 else text)]
    fixed += [(row, 2, "その他") for row in (end - 5, end - 4)] + [(end - 5, 7, "5"), (end, 1, lo.END), (end + 1, 2, "一人当たり"), (end + 1, 7, "9")]
    fixed += [(LAYOUT.group_row, 7 + 5 * i, r) for i, r in enumerate(QUARTERS)]
    return _stored(leaves.unionByName(years).unionByName(totals).unionByName(_cells(sheets, name, *fixed)))


_IDX = lambda values, c: f"(list_position([{', '.join(repr(v) for v in values)}], {c}) - 1)"
BOOK = f"""o AS (SELECT 'C' || o_custkey AS sheet, {_IDX(STATES, 'o_orderstatus')} AS s, year(o_orderdate) AS y, o_orderpriority AS prio, {_IDX(PRIORITIES, 'o_orderpriority')} AS p, quarter(o_orderdate) - 1 AS r,
    CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) AS g, 'B' || CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) AS sub FROM orders),
v AS (SELECT sheet, s, replace(y || '年/' || prio, ' ', '') AS path, r, sub, g, {START} + {HEIGHT} * s + 4 + 6 * (y - 1992) + 1 + p AS row, CASE WHEN p = 3 THEN count(*) / 2.0 ELSE count(*) END AS n FROM o GROUP BY sheet, s, y, prio, p, r, sub, g
    UNION ALL SELECT sheet, s, y || '年', r, sub, g, {START} + {HEIGHT} * s + 4 + 6 * (y - 1992), count(*) FROM o GROUP BY sheet, s, y, r, sub, g
    UNION ALL SELECT sheet, s, '合計', r, sub, g, {START} + {HEIGHT} * s + 3, count(*) FROM o GROUP BY sheet, s, r, sub, g)"""


@query(f"""WITH {BOOK}, c AS (SELECT *, CAST(7 + 5 * r + g AS INTEGER) AS col FROM v WHERE sheet NOT LIKE '%7')
    SELECT sheet, ['BS', 'PL', 'CF'][s + 1] AS section, path, 'R' || r AS code, sub, CASE WHEN n = floor(n) THEN CAST(n AS BIGINT) END AS value, chr(64 + col) || row AS place, CASE WHEN n <> floor(n) THEN 'not_integer' END AS reason FROM c
    UNION ALL SELECT DISTINCT sheet, 'CF', 'その他', NULL, NULL, NULL, NULL, 'duplicate_path' FROM o WHERE sheet NOT LIKE '%7'""")
def statement_paths(spark, sf):
    out = lo.statement_values(statement_sheets(spark, sf), LAYOUT)
    return out.withColumn("value", F.col("value").cast("long"))


@query("SELECT DISTINCT 'C' || o_custkey AS sheet, 'heads_differ' AS defect, 1 AS n, 'J' AS places FROM orders WHERE o_custkey % 10 = 7")
def statement_defects(spark, sf):
    cells = statement_sheets(spark, sf)
    return lo.sheet_defects(lo.statement_columns(cells, lo.statement_rows(cells, LAYOUT), LAYOUT))


#: The orders' years moved on so that they cross from one era to the next.
SHIFT = 22


def _years(spark, sf):
    o = dealt(table(spark, sf, "orders"), "o_custkey", each=ORDERS).groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("price"))
    first = F.min("year").over(lo.Window.partitionBy("o_custkey"))
    ours = F.col("year") + SHIFT
    era, number = F.when(ours < 2019, "平成").otherwise("令和"), F.when(ours < 2019, ours - 1988).otherwise(ours - 2018)
    o = o.withColumns({"era": era, "number": F.when(number == 1, "元").otherwise(number.cast("string")), "sheet": F.concat(F.lit("C"), "o_custkey"), "first": first})
    # the era is printed where it begins
    return o.withColumn("opens", (F.col("year") == F.col("first")) | (F.col("year") + SHIFT == 2019) | ((F.col("first") + SHIFT < 2019) & (F.lag("year").over(lo.Window.partitionBy("o_custkey").orderBy("year")) + SHIFT < 2019) & (F.col("year") + SHIFT >= 2019)))


PERIODS = f"y AS (SELECT 'C' || o_custkey AS sheet, 'FY' || (year(o_orderdate) + {SHIFT}) AS period, year(o_orderdate) AS y, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS price FROM orders GROUP BY ALL)"


@query(f"WITH {PERIODS} SELECT 'rows' AS layout, sheet, period, CAST(n AS DOUBLE) AS value FROM y UNION ALL SELECT 'blocks', sheet, period, CAST(price AS DOUBLE) FROM y")
def era_tables(spark, sf):
    """Years down a sheet, the era where it begins; and blocks with the total inside."""
    y = _years(spark, sf)
    at, opens = 7 + F.col("year") - 1992, F.col("opens")
    rows = _cells(y, F.col("sheet"), (at, 1, F.when(opens, F.col("era"))), (at, 2, F.concat("number", F.lit("年度"))), (at, 5, F.col("n")), (2, 5, "件数"))
    block = 1 + 5 * (F.col("year") - 1992)
    blocks = _cells(y, F.col("sheet"), (block, 1, F.when(opens, F.col("era"))), (block + 1, 1, F.col("number")), (block + 2, 2, "小計"), (block + 2, 4, "1"), (block + 3, 2, "計"), (block + 3, 4, F.format_number("price", 2)))
    one = lo.year_rows(rows, 5).select(F.lit("rows").alias("layout"), "sheet", "period", F.col("value").cast("double").alias("value"))
    return one.unionByName(lo.year_blocks(blocks, 4).select(F.lit("blocks").alias("layout"), "sheet", "period", F.col("value").cast("double").alias("value")))


@query(f"""WITH {PERIODS} SELECT sheet, '歳入' AS label, 0 AS occurrence, period, CAST(n AS DOUBLE) AS value, NULL AS reason FROM y UNION ALL SELECT sheet, '計', 2, period, CAST(price AS DOUBLE), NULL FROM y
    UNION ALL SELECT DISTINCT sheet, '計', 0, NULL, NULL, 'several_rows' FROM y UNION ALL SELECT DISTINCT sheet, '歳出', 0, NULL, NULL, 'no_row' FROM y""")
def era_heads(spark, sf):
    """Years across a sheet, the era carried to the right; columns of forecasts are no years."""
    y = _years(spark, sf)
    col = F.col("year") - 1986
    cells = _cells(y, F.col("sheet"), (3, col, F.concat(F.when(F.col("opens"), F.col("era")).otherwise(""), "number")), (5, col, F.col("n")), (7, col, "-1"), (9, col, F.format_number("price", 2)))
    fixed = _cells(y.select("sheet").distinct(), F.col("sheet"), (3, 1, "事項"), (3, 40, "9（決算見込額）"), (5, 40, "77"), (5, 2, "歳 入"), (7, 3, "計"), (9, 3, "計"))
    asked = y.select("sheet", F.explode(F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("occurrence")) for a, b in (("歳入", 0), ("計", 2), ("計", 0), ("歳出", 0))))).alias("a")).select("sheet", "a.*").distinct()
    return lo.year_columns(_stored(cells.unionByName(fixed)), asked, 3).select("sheet", "label", "occurrence", "period", F.col("value").cast("double").alias("value"), "reason")


@query(f"""WITH k AS (SELECT 'C' || o_custkey || '!' || CASE WHEN y + {SHIFT} < 2019 THEN '平成' || (y + {SHIFT} - 1988) WHEN y + {SHIFT} = 2019 THEN '令和元' ELSE '令和' || (y + {SHIFT} - 2018) END AS sheet, 'FY' || (y + {SHIFT}) AS period, o_orderpriority AS section, count(*) AS n FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY o_custkey, y, o_orderpriority)
    SELECT sheet, section, head, period, CASE WHEN head = '決算額' AND section < '3' THEN n END AS value, CASE WHEN head = '予算' THEN 'head_columns' WHEN section LIKE '3%' THEN 'totals' WHEN section LIKE '5%' THEN 'several_rows' END AS reason
    FROM (SELECT *, replace(section, ' ', '') AS s FROM k), (VALUES ('決算額'), ('予算')) AS h(head) WHERE head = '予算' OR section NOT LIKE '4%'""".replace("SELECT sheet, section, head", "SELECT sheet, s AS section, head"))
def year_sheet_sections(spark, sf):
    """A book a customer, a sheet a year, a row a priority: complete, with a total below, with two, with a dash, and printed twice."""
    ours = F.col("year") + SHIFT
    name = F.when(ours < 2019, F.concat(F.lit("平成"), (ours - 1988).cast("string"))).when(ours == 2019, "令和元").otherwise(F.concat(F.lit("令和"), (ours - 2018).cast("string")))
    o = dealt(table(spark, sf, "orders"), "o_custkey", each=ORDERS).groupBy("o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count("*").alias("n"))
    o = o.withColumns({"sheet": F.concat(F.lit("C"), "o_custkey", F.lit("!"), name), "p": _index(PRIORITIES, "o_orderpriority")})
    at, n, p = 10 + 5 * F.col("p"), F.col("n"), F.col("p")
    body = _cells(o, F.col("sheet"), (at, 2, F.when(p == 0, F.concat(F.lit("（"), "o_orderpriority", F.lit("）"))).otherwise(F.col("o_orderpriority"))), (at, 6, F.when(p.isin(0, 4), n)), (at, 5, F.when(p == 3, "12")), (at, 6, F.when(p == 3, "－")),
                  (at + 1, 3, F.when(p.isin(1, 2), "計")), (at + 1, 6, F.when(p.isin(1, 2), n)), (at + 2, 3, F.when(p == 2, "合計")), (at + 2, 6, F.when(p == 2, n)), (at + 2, 3, F.when(p == 4, F.col("o_orderpriority"))), (at + 2, 6, F.when(p == 4, "1")))
    fixed = _cells(o.select("sheet").distinct(), F.col("sheet"), (3, 4, "予算"), (3, 5, "予 算"), (3, 6, "決算額"))
    asked = spark.createDataFrame([(s, h) for s in PRIORITIES for h in ("決算額", "予算")], "section string, head string")
    return lo.year_sheets(_stored(body.unionByName(fixed)), asked).select("sheet", "section", "head", "period", F.col("value").cast("long").alias("value"), "reason")


@query("""WITH o AS (SELECT 'C' || o_custkey AS sheet, 'FY' || year(o_orderdate) AS period, replace(o_orderpriority, ' ', '') AS g, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY ALL)
    SELECT 'national' AS kind, sheet, g AS head, period, CAST(sum(n) * 2 AS DOUBLE) AS value, NULL AS reason FROM o GROUP BY sheet, g, period UNION ALL SELECT DISTINCT 'national', sheet, 'NOWHERE', NULL, NULL, 'columns' FROM o
    UNION ALL SELECT 'regional', sheet, 'R' || (q - 1), period, CAST(sum(n) AS DOUBLE), NULL FROM o WHERE sheet IN (SELECT sheet FROM o GROUP BY 1 HAVING count(DISTINCT q) = 4) GROUP BY sheet, q, period
    UNION ALL SELECT 'regional', sheet, NULL, NULL, NULL, 'missing_region' FROM o GROUP BY sheet HAVING count(DISTINCT q) < 4""")
def two_level_heads(spark, sf):
    """A sheet a customer: priorities over single and double counts, years down; and quarters in the place of regions down, years across."""
    o, name = _orders(spark, sf), F.col("sheet")
    by = o.groupBy("sheet", "year", "o_orderpriority").agg(F.count("*").alias("n"))
    col, row = 2 + 2 * _index(PRIORITIES, "o_orderpriority"), F.col("year") - 1987
    sheets = o.select("sheet").distinct()
    heads = [(2, 2 + 2 * i, p) for i, p in enumerate(PRIORITIES)] + [(3, 2 + i, ("件 数", "倍 数")[i % 2]) for i in range(10)]
    national = _cells(by, name, (row, 1, F.col("year")), (row, col, F.col("n")), (row, col + 1, F.col("n") * 2)).distinct().unionByName(_cells(sheets, name, *heads, (30, 1, "合計"), (30, 2, "9")))
    asked = sheets.select("sheet", F.explode(F.array(*map(F.lit, PRIORITIES), F.lit("NOWHERE"))).alias("group"), F.lit("倍数").alias("sub"))
    quarters = o.groupBy("sheet", "year", "quarter").agg(F.count("*").alias("n"))
    at = 4 + _index(QUARTERS, "quarter")
    regional = _cells(quarters, name, (at, 1, F.col("quarter")), (3, F.col("year") - 1990, F.col("year")), (at, F.col("year") - 1990, F.col("n"))).distinct().unionByName(_cells(sheets, name, (3, 1, "年度"), (12, 1, "注"), (12, 4, "5")))
    one = lo.two_level(_stored(national), asked).select(F.lit("national").alias("kind"), "sheet", F.col("group").alias("head"), "period", F.col("value").cast("double").alias("value"), "reason")
    return one.unionByName(lo.region_sheet(_stored(regional), LAYOUT.groups).select(F.lit("regional").alias("kind"), "sheet", F.col("code").alias("head"), "period", F.col("value").cast("double").alias("value"), "reason"))
