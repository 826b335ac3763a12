"""The engine's models (facts, series, chunks, units) made from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.shared import tasks_for

FIRST, LAST = 1995, 2001
ITEMS = ("revenue", "gross", "quantity", "tax")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str, company: str = "l_suppkey") -> DataFrame:
    """Sums of the lines by company, status, order year and the year in which they were recorded: small before any join.

    Lines meet their orders, and are dealt by company, in as many tasks as they call for; what goes by company needs no
    other exchange.
    """
    price, part = F.col("l_extendedprice").cast("decimal(12,2)"), F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    items = table(spark, sf, "lineitem")
    tasks = tasks_for(items)
    items = items.select("l_orderkey", "l_suppkey", "l_linestatus", F.year("l_shipdate").alias("shipped"), (price * part).alias("revenue"), price.alias("gross"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), (price * F.col("l_tax").cast("decimal(4,2)")).alias("tax"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("period"))
    both = items.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    each = both.select(F.col(company).alias("company"), F.col("l_linestatus").alias("st"), "period", F.greatest("period", "shipped").alias("rec"), *ITEMS)
    return each.repartition(tasks, "company").groupBy("company", "st", "period", "rec").agg(*(F.sum(i).alias(i) for i in ITEMS))


def facts(spark: SparkSession, sf: str, company: str = "l_suppkey") -> DataFrame:
    """company, doc, basis, period and the items: document Y has the periods Y - 4 to Y as recorded by the end of Y."""
    each = lines(spark, sf, company).filter(F.col("rec") <= F.least(F.col("period") + 4, F.lit(LAST)))
    each = each.withColumn("doc", F.explode(F.sequence("rec", F.least(F.col("period") + 4, F.lit(LAST)))))
    bases = F.when(F.col("st") == "O", F.array(F.lit("consolidated"), F.lit("non_consolidated"))).otherwise(F.array(F.lit("consolidated")))
    return each.withColumn("basis", F.explode(bases)).groupBy("company", "doc", "basis", "period").agg(*(F.sum(i).alias(i) for i in ITEMS))


def _facts_sql(company: str) -> str:
    return f"""lines AS (
    SELECT {company} AS company, l_linestatus AS st, CAST(year(o_orderdate) AS INTEGER) AS period, CAST(greatest(year(o_orderdate), year(l_shipdate)) AS INTEGER) AS rec,
           sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS gross,
           sum(CAST(l_quantity AS DECIMAL(12,2))) AS quantity, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tax
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
facts AS (
    SELECT company, doc, basis, period, sum(revenue) AS revenue, sum(gross) AS gross, sum(quantity) AS quantity, sum(tax) AS tax
    FROM lines JOIN (SELECT CAST(unnest(range({FIRST}, {LAST + 1})) AS INTEGER) AS doc) ON doc BETWEEN rec AND period + 4
    JOIN (VALUES ('consolidated'), ('non_consolidated')) AS b(basis) ON basis = 'consolidated' OR st = 'O' GROUP BY 1, 2, 3, 4)"""


FACTS = _facts_sql("l_suppkey")
CUSTOMER_FACTS = _facts_sql("o_custkey")


def series_values(spark: SparkSession, sf: str) -> DataFrame:
    """series_id, its parts, period, year, sub, region and value: orders by segment and priority, each also for all."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    geo = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("org"))
    day = F.col("o_orderdate")
    base = orders.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("org", F.lower("c_mktsegment").alias("seg"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("prio"), F.year(day).alias("year"), F.month(day).alias("month"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    base = base.groupBy("org", "seg", "prio", "year", "month").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    base = base.withColumn("seg", F.explode(F.array("seg", F.lit("all")))).withColumn("prio", F.explode(F.array("prio", F.lit("all"))))
    base = base.withColumn("f", F.explode(F.array(F.struct(F.lit("a").alias("freq"), F.lit(0).alias("sub")), F.struct(F.lit("q").alias("freq"), F.ceil(F.col("month") / 3).cast("int").alias("sub")), F.struct(F.lit("m").alias("freq"), F.col("month").alias("sub")))))
    total = base.groupBy("org", "seg", "prio", "f.freq", "year", "f.sub").agg(F.sum("n").cast("double").alias("count"), F.sum("price").cast("double").alias("value"))
    long = total.unpivot(["org", "seg", "prio", "freq", "year", "sub"], ["count", "value"], "measure", "v")
    period = F.when(F.col("freq") == "a", F.col("year").cast("string")).when(F.col("freq") == "q", F.concat("year", F.lit("Q"), "sub")).otherwise(F.concat("year", F.lit("-"), F.lpad(F.col("sub").cast("string"), 2, "0")))
    sid = F.concat_ws(".", "org", F.lit("orders"), "measure", F.concat_ws("-", "seg", "prio"), "freq")
    return long.select(sid.alias("series_id"), "org", "measure", "seg", "prio", "freq", "year", "sub", period.alias("period"), F.lit("ALL").alias("region"), F.round("v", 2).alias("value"))


SERIES = """sv AS (
    SELECT org || '.orders.' || measure || '.' || seg || '-' || prio || '.' || freq AS series_id, org, measure, seg, prio, freq, year, sub,
           CASE freq WHEN 'a' THEN CAST(year AS VARCHAR) WHEN 'q' THEN year || 'Q' || sub ELSE year || '-' || lpad(CAST(sub AS VARCHAR), 2, '0') END AS period, 'ALL' AS region,
           round(CASE measure WHEN 'count' THEN CAST(n AS DOUBLE) ELSE CAST(price AS DOUBLE) END, 2) AS value
    FROM (SELECT lower(replace(r_name, ' ', '_')) AS org, s.seg, p.prio, f.freq, CAST(year(o_orderdate) AS INTEGER) AS year,
                 CAST(CASE f.freq WHEN 'a' THEN 0 WHEN 'q' THEN quarter(o_orderdate) ELSE month(o_orderdate) END AS INTEGER) AS sub, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS price
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
               LATERAL (SELECT unnest([lower(c_mktsegment), 'all']) AS seg) s, LATERAL (SELECT unnest(['p' || substr(o_orderpriority, 1, 1), 'all']) AS prio) p, (VALUES ('a'), ('q'), ('m')) AS f(freq)
          GROUP BY ALL), (VALUES ('count'), ('value')) AS m(measure)),
sc AS (SELECT DISTINCT series_id, org, measure, seg, prio, freq FROM sv)"""


def catalog(values: DataFrame) -> DataFrame:
    return values.select("series_id", "org", "measure", "seg", "prio", "freq").distinct()


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """id, text, org, lang, layer, size: public only where a label says that nothing is wrong, else restricted."""
    fine = table(spark, sf, "labels").filter("toxic = 0").select(F.col("doc_id").alias("_id")).distinct()
    d = table(spark, sf, "documents")
    return d.join(fine, F.col("doc_id") == F.col("_id"), "left").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("org"), "lang", F.when(F.col("_id").isNotNull(), "public").otherwise("restricted").alias("layer"), F.col("n_chars").alias("size"))


CHUNKS = """ch AS (SELECT doc_id AS id, text, source AS org, lang, n_chars AS size, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 'public' ELSE 'restricted' END AS layer FROM documents)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """company, doc, period, member, value: quantities by priority; document Y has Y and Y - 1. 3-MEDIUM is named without figures."""
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("shipped"), F.col("l_quantity").cast("decimal(12,2)").alias("q"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("member"), F.year("o_orderdate").alias("period"))
    each = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("company", "member", "period", F.greatest("period", "shipped").alias("rec")).agg(F.sum("q").alias("q"))
    each = each.filter(F.col("rec") <= F.col("period") + 1).withColumn("doc", F.explode(F.sequence("rec", F.col("period") + 1)))
    return each.groupBy("company", "doc", "period", "member").agg(F.sum(F.when(F.col("member") != "3-MEDIUM", F.col("q"))).cast("double").alias("value"))


SEGMENTS = """sg AS (SELECT company, CAST(doc AS INTEGER) AS doc, period, member, CAST(sum(CASE WHEN member <> '3-MEDIUM' THEN q END) AS DOUBLE) AS value
    FROM (SELECT l_suppkey AS company, o_orderpriority AS member, CAST(year(o_orderdate) AS INTEGER) AS period, greatest(year(o_orderdate), year(l_shipdate)) AS rec, sum(CAST(l_quantity AS DECIMAL(12,2))) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4) e
    JOIN (SELECT unnest(range(1990, 2010)) AS doc) d ON doc BETWEEN rec AND period + 1 GROUP BY 1, 2, 3, 4)"""
