"""Tables by region made from the lines: each supplier prints a year's sales by its customers' regions in one of eight layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import regions as rg
from quillstone.plans.adapters import table
from quillstone.plans.catalog import query

#: Names of the regions as the tables print them, by region key; the supplier's own region is home.
NAMES = ("アフリカ", "アメリカ", "アジア", "ヨーロッパ", "中東")


def sales(spark, sf):
    """company, year, home (its region's sales), v0 to v4 (sales by region), tagged (all sales), before (all sales a year ago)."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    customers = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey"), F.col("n_regionkey").alias("region"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("company"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    each = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("company", "year", "region").agg(F.sum("price").alias("v"))
    suppliers = table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("company"), F.col("n_regionkey").alias("own"))
    each = each.join(suppliers, "company")
    at = lambda r: F.coalesce(F.sum(F.when(F.col("region") == r, F.col("v"))), F.lit(0))
    wide = each.groupBy("company", "year", "own").agg(*(at(r).alias(f"v{r}") for r in range(5)), F.coalesce(F.sum(F.when(F.col("region") == F.col("own"), F.col("v"))), F.lit(0)).alias("home"), F.sum("v").alias("tagged"))
    last = wide.select("company", (F.col("year") + 1).alias("year"), F.col("tagged").alias("before"))
    return wide.join(last, ["company", "year"], "left")


def sections(spark, sf):
    """A section for each company and year but in layout 7: one of seven ways to print, or not to print, the sales by region."""

    def cell(text, rowspan=None, colspan=None):
        text = text if hasattr(text, "alias") else F.lit(text)
        return F.struct(text.cast("string").alias("text"), F.lit(rowspan).cast("int").alias("rowspan"), F.lit(colspan).cast("int").alias("colspan"), F.lit(None).cast("int").alias("tables"))

    row = lambda *cells: F.array(*(c if hasattr(c, "alias") and not isinstance(c, str) else cell(c) for c in cells))
    grid = lambda *rows: F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), F.array(*rows).alias("rows"))
    para = lambda t: F.struct(F.lit("text").alias("type"), F.lit(t).alias("text"), F.lit(None).cast("array<array<struct<text:string,rowspan:int,colspan:int,tables:int>>>").alias("rows"))
    thousands = lambda c: F.floor(c / 1000)
    num = lambda c: cell(F.format_number(thousands(F.col(c) if isinstance(c, str) else c), 0))
    own = F.col("own")
    name = lambda r, mark="": F.concat(F.when(own == r, "日本").otherwise(NAMES[r]), F.lit(mark))
    split = thousands(F.col("home") / 2)
    across = grid(row("", *(cell(name(r)) for r in range(5)), "合計"), row("売上高", *(num(f"v{r}") for r in range(5)), num("tagged")))
    before = F.coalesce(F.format_number(thousands(F.col("before")), 0), F.lit("－"))
    down = grid(row("", "前期", "当期"), *(row(cell(name(r, "（注）1")), "－", num(f"v{r}")) for r in range(5)), row("合計", cell(before), num("tagged")))
    merged = grid(
        row(cell("地域別", 2), cell("国内", None, 2), cell("海外"), cell("合　計", 2)), row("製品", "役務", "計の内訳"),
        row("売上高", cell(F.format_number(split, 0)), cell(F.format_number(thousands(F.col("home")) - split, 0)), num(F.col("tagged") - F.col("home")), num("tagged")),
    )
    assets = grid(row("本邦", "その他", "合計"), row("11", "22", cell(F.format_number(thousands(F.col("tagged")) * 2 + 7, 0))))
    units = grid(row(cell("（単位：千円）", None, 3)))
    noted = grid(row("国内（注）1", "海外（注）2", "連結売上高※1"), row(*(cell(F.concat(F.format_number(thousands(c), 0), F.lit("千円"))) for c in (F.col("home"), F.col("tagged") - F.col("home"), F.col("tagged")))))
    abroad = grid(row(cell("北米"), "その他", "合計"), row(num("home"), num(F.col("tagged") - F.col("home")), num("tagged")))
    framed = grid(row("本邦以外の外部顧客への売上高はありません。"), row("", ""))
    layout = F.col("company") % 8
    content = (
        F.when(layout == 0, F.array(para("（単位：千円）顧客の所在地を基礎とし、分類しております。"), across))
        .when(layout == 1, F.array(para("売上高"), down)).when(layout == 2, F.array(merged)).when(layout == 3, F.array(framed))
        .when(layout == 4, F.array(para("本邦の外部顧客への売上高が連結売上高の90％を超えるため、記載を省略しております。")))
        .when(layout == 5, F.array(units, assets, noted)).when(layout == 6, F.array(abroad))
    )
    year = F.col("year").cast("string")
    out = sales(spark, sf).filter(layout != 7)
    # exploding an array of one keeps the content a column, as if it were read, instead of an expression at each use
    n = F.size(F.filter(content, lambda x: x.type == "table")) + (F.col("company") % 8 == 2).cast("int") * (F.col("year") == 1996).cast("int")
    return out.select("company", F.concat(F.lit("D"), year).alias("doc"), F.lit("consolidated").alias("basis"), F.lit(rg.SECTION).alias("section"), F.lit("CurrentYearDuration").alias("context"), F.concat(year, F.lit("-12")).alias("period"), F.explode(F.array(content.cast(rg.CONTENT))).alias("content"), n.alias("source_tables"))


def requests(spark, sf):
    """Every company and year; a document of layout 5 of 1997 has no tagged revenue."""
    year = F.col("year").cast("string")
    tagged = F.when((F.col("company") % 8 != 5) | (F.col("year") != 1997), F.col("tagged"))
    return sales(spark, sf).select("company", F.concat(F.lit("D"), year).alias("doc"), F.lit("consolidated").alias("basis"), F.concat(year, F.lit("-12")).alias("period"), F.lit(False).alias("ifrs"), tagged.alias("tagged"))


SALES = """sl AS (
    SELECT l_suppkey AS company, year(o_orderdate) AS year, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS tagged, coalesce(sum(CASE WHEN c.n_regionkey = s.n_regionkey THEN CAST(l_extendedprice AS DECIMAL(12,2)) END), 0) AS home
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2),
k AS (SELECT company, year, company % 8 AS layout, CAST(floor(tagged / 1000) AS BIGINT) AS total, CAST(floor(home / 1000) AS BIGINT) AS home, CAST(floor(home / 2 / 1000) AS BIGINT) AS part FROM sl),
r AS (SELECT *, CASE WHEN layout = 7 THEN 'regions_not_tagged' WHEN layout = 3 THEN NULL WHEN layout = 4 THEN 'overseas_statement_only' WHEN layout = 5 AND year = 1997 THEN 'home_or_total_not_identified'
        WHEN layout = 6 THEN CASE WHEN total >= 0 THEN 'home_not_in_table' END WHEN total = 0 THEN 'home_or_total_not_identified' WHEN layout = 2 AND part <> home - part THEN 'home_or_total_not_identified' END AS reason FROM k),
ratio AS (SELECT *, CASE WHEN reason IS NULL THEN CASE layout WHEN 3 THEN 0.0 WHEN 2 THEN CAST(total - part AS DOUBLE) / CAST(total AS DOUBLE) ELSE CAST(total - home AS DOUBLE) / CAST(total AS DOUBLE) END END AS value FROM r)"""


@query(
    "WITH " + SALES + """ SELECT company, 'D' || year AS doc, year || '-12' AS period, value, reason,
        CASE WHEN reason = 'home_or_total_not_identified' THEN CASE WHEN layout = 5 AND year = 1997 THEN 'no tagged revenue' WHEN total = 0 THEN 'no pair of home and total' ELSE '2 pairs' END END AS why,
        CASE WHEN reason IS NULL AND layout <> 3 THEN CASE WHEN layout = 5 THEN format('{:,}千円', home) WHEN layout = 2 THEN format('{:,}', part) ELSE format('{:,}', home) END END AS home_text,
        CASE WHEN reason IS NULL AND layout <> 3 THEN CAST(1000 AS BIGINT) END AS unit, CASE WHEN reason IS NULL AND layout <> 3 THEN CAST(CASE layout WHEN 5 THEN 1 ELSE 0 END AS INTEGER) END AS "table",
        CASE WHEN layout = 3 THEN 'none_outside' END AS statement FROM ratio"""
)
def overseas_ratio(spark, sf):
    return rg.overseas_ratio(requests(spark, sf), sections(spark, sf)).select("company", "doc", "period", "value", "reason", "why", "home_text", "unit", "table", "statement")


@query("WITH " + SALES + " SELECT coalesce(reason, CASE WHEN layout = 3 THEN 'none_outside' ELSE 'value' END) AS outcome, count(*) AS n, min(value) AS least, max(value) AS most FROM ratio GROUP BY 1")
def overseas_outcomes(spark, sf):
    out = rg.overseas_ratio(requests(spark, sf), sections(spark, sf))
    return out.groupBy(F.coalesce("reason", "statement", F.lit("value")).alias("outcome")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(
    """WITH y AS (SELECT DISTINCT l_suppkey AS company, CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    q AS (SELECT company, year AS y FROM y UNION SELECT company, year - 1 FROM y)
    SELECT q.company, q.y || '-12' AS period, a.company IS NOT NULL AND q.company % 8 NOT IN (3, 4, 7) AS found,
        CASE WHEN q.company % 8 = 7 OR a.company IS NULL THEN 'not_tagged' WHEN q.company % 8 IN (3, 4) THEN 'omitted' END AS reason,
        'D' || CASE WHEN q.company % 8 = 7 OR a.company IS NULL THEN coalesce(b.year, a.year) ELSE a.year END AS doc, CAST(CASE WHEN q.company % 8 = 7 THEN 0 ELSE count(a.year) OVER (PARTITION BY q.company, q.y) END AS INTEGER) AS n_sections
    FROM q LEFT JOIN y a ON a.company = q.company AND a.year = q.y LEFT JOIN y b ON b.company = q.company AND b.year = q.y + 1"""
)
def region_lookup(spark, sf):
    """The sections of every year that some document covers, as its own or as the one before."""
    filings = requests(spark, sf).select("company", "doc", "basis", "period")
    year = F.substring("period", 1, 4).cast("int")
    before = F.concat((year - 1).cast("string"), F.lit("-12"))
    documents = filings.select("company", "doc", F.concat((year + 1).cast("string"), F.lit("-06-25")).alias("submitted"), F.col("period").alias("current"), before.alias("prior"))
    asked = filings.select("company", "basis", "period").union(filings.select("company", "basis", before)).distinct()
    out = rg.region_sections(asked, documents, sections(spark, sf))
    return out.select("company", "period", "found", "reason", "doc", F.coalesce(F.size("sections"), F.lit(0)).alias("n_sections"))


@query(
    """WITH y AS (SELECT DISTINCT l_suppkey AS company, year(o_orderdate) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT company, 'D' || year AS doc, '1 of 2' AS why FROM y WHERE company % 8 = 2 AND year = 1996"""
)
def table_copies(spark, sf):
    return rg.unfaithful_copies(sections(spark, sf)).select("company", "doc", "why")
