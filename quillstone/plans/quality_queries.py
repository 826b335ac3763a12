"""Words of searches, parts of ids, flags of cells, equality of id sets, retention and versions of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import query_words, version_key
from quillstone.operators import checks, series, usage
from quillstone.plans.adapters import SERIES, catalog, series_values, table
from quillstone.plans.catalog import query

SEARCHES = [("実質GDP 成長率", "実質|GDP|成長率"), ("GDPギャップ、CPI・GDP", "GDP|ギャップ|CPI"), ("a-b_c 50%", "a-b_c|50%"), ("  ", ""), ("大企業／中小企業\u3000大企業", "大企業|中小企業"), ("x,y/z", "x|y|z")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{w}')" for s, w in SEARCHES) + ") AS t(search, words)")
def search_words(spark, sf):
    rows = spark.createDataFrame([(s,) for s, _ in SEARCHES], "search string")
    return rows.select("search", F.array_join(query_words(F.col("search")), "|").alias("words"))


@query(f"""WITH {SERIES}, c AS (SELECT org, measure || t AS measure, seg || '-' || prio AS dims, freq || f AS ending, freq FROM sc, (VALUES ('', ''), ('.total', '.pref')) AS x(t, f))
    SELECT org || '.orders.' || measure || '.' || dims || '.' || ending AS series_id, org, 'orders' AS dataset, measure, dims, freq FROM c UNION ALL SELECT 'asia.orders.nothing.all-all.a', NULL, NULL, NULL, NULL, NULL""")
def series_id_parts(spark, sf):
    dims = F.concat_ws("-", "seg", "prio")
    forms = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f in (("", ""), (".total", ".pref")))))
    c = catalog(series_values(spark, sf)).withColumn("x", forms).select("org", F.lit("orders").alias("dataset"), F.concat("measure", "x.t").alias("measure"), dims.alias("dims"), "freq", "x.f")
    c = c.withColumn("series_id", F.concat(F.concat_ws(".", "org", "dataset", "measure", "dims", "freq"), "f"))
    return series.id_parts(c.select("series_id").union(spark.createDataFrame([("asia.orders.nothing.all-all.a",)], "series_id string")), c)


@query(f"""WITH {SERIES}, d AS (SELECT series_id, seg, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY year, sub)) AS d FROM sv WHERE freq = 'q' AND value > 0), g AS (SELECT series_id, seg, list_sort(list(d)) AS ds FROM d WHERE d IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8),
    m AS (SELECT *, ds[len(ds) // 2 + 1] AS m FROM g), x AS (SELECT series_id, seg, round(1.4826 * list_sort([abs(x - m) FOR x IN ds])[len(ds) // 2 + 1], 4) AS dispersion FROM m),
    f AS (SELECT c.series_id, c.dispersion >= 0.15 AND round(c.dispersion / nullif(p.dispersion, 0), 2) >= 2 AS volatile FROM x c JOIN x p ON p.series_id = replace(c.series_id, '.' || c.seg || '-', '.all-') WHERE c.seg <> 'all'),
    n AS (SELECT replace(series_id, '.count.', '.value.') AS series_id, arg_max(value, year * 100 + sub) AS members FROM sv WHERE freq = 'q' AND measure = 'count' GROUP BY 1),
    b AS (SELECT coalesce(f.series_id, n.series_id) AS series_id, concat_ws(',', CASE WHEN volatile THEN 'volatile' END, CASE WHEN members < 100 THEN 'small_cell' END) AS flags FROM f FULL JOIN n ON f.series_id = n.series_id)
    SELECT series_id, flags FROM b WHERE flags <> ''""")
def series_cell_flags(spark, sf):
    v = series_values(spark, sf).filter("freq = 'q'")
    parent = F.replace("series_id", F.concat(F.lit("."), "seg", F.lit("-")), F.lit(".all-"))
    flags = series.volatile(series.dispersion(v), catalog(v).filter("seg <> 'all'").select("series_id", parent.alias("parent")))
    members = v.filter("measure = 'count'").select(F.replace("series_id", F.lit(".count."), F.lit(".value.")).alias("series_id"), (F.col("year") * 100 + F.col("sub")).alias("at"), "value")
    return series.cell_flags(flags, members)


@query("""WITH o AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997), i AS (SELECT count(*) AS "both" FROM (SELECT o_custkey FROM o INTERSECT SELECT c_custkey FROM customer)), a AS (SELECT count(*) AS only_a FROM (SELECT o_custkey FROM o EXCEPT SELECT c_custkey FROM customer)), b AS (SELECT count(*) AS only_b FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM o))
    SELECT "both", only_a, only_b, only_a + only_b = 0 AS equal FROM i, a, b""")
def id_set_equality(spark, sf):
    return checks.same_ids(table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997").select(F.col("o_custkey").alias("key")), table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def retained_events(spark, sf):
    e = table(spark, sf, "events")
    kept = usage.retained(e, "ts", e.agg(F.max("ts")).first()[0], 7)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT version_key, count(*) AS n FROM (SELECT CASE WHEN source = (SELECT min(source) FROM documents) THEN source || '_' || lang END AS version_key FROM documents WHERE NOT contains(source, '_') AND NOT contains(lang, '_')) GROUP BY 1")
def file_versions(spark, sf):
    d = table(spark, sf, "documents").filter(~F.contains("source", F.lit("_")) & ~F.contains("lang", F.lit("_")))
    first = table(spark, sf, "documents").agg(F.min("source")).first()[0]
    name = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    return d.groupBy(version_key(name, [first]).alias("version_key")).agg(F.count("*").alias("n"))
