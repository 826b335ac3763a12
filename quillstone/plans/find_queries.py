"""Finding series of the orders: families by dimensions, variants and frequencies, and why nothing was found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import find
from quillstone.plans.adapters import SERIES, catalog, series_values
from quillstone.plans.catalog import query

SEGMENTS = ("automobile", "building", "furniture", "household", "machinery", "all")
AXES = find.Axes(variant_datasets=("asia", "europe"), items=SEGMENTS, whole="all", freq_datasets=("america",))


def find_catalog(spark, sf):
    """A data set for each region; measures are a segment and a measure, dimensions the priority; Africa's p5 is superseded."""
    measure, words = F.concat_ws("_", "seg", "measure"), F.create_map(*(F.lit(x) for x in ("a", "annual", "q", "quarterly", "m", "monthly")))
    return catalog(series_values(spark, sf)).select(
        "series_id", F.col("org").alias("dataset"), measure.alias("measure"), F.col("prio").alias("dims"), "freq", (F.col("prio") != "all").cast("int").alias("specificity"), F.concat_ws(" ", "seg", F.lit("orders")).alias("title"),
        words[F.col("freq")].alias("notes"), F.lit("orders").alias("stat_name"), F.lit("").alias("table_title"), F.when(F.col("org") == "europe", "intl").otherwise("jp").alias("scope"),
        F.when((F.col("org") == "africa") & (F.col("prio") == "p5"), "next").alias("superseded_by"), F.array("measure").alias("tags"),
    )


FOUND = f"""{SERIES}, c AS (SELECT series_id, org AS dataset, seg, measure AS variant, seg || '_' || measure AS measure, prio AS dims, freq, CASE WHEN prio <> 'all' THEN 1 ELSE 0 END AS specificity,
    lower(seg || ' orders ' || series_id || ' ' || seg || '_' || measure) AS p, CASE freq WHEN 'a' THEN 'annual' WHEN 'q' THEN 'quarterly' ELSE 'monthly' END || ' orders ' AS s FROM sc),
g AS (SELECT *, bool_or(dataset = 'africa' AND dims = 'p5') OVER (PARTITION BY dataset) AS legacy FROM c),
h AS (SELECT *, CASE WHEN contains(p, 'value') AND contains(p, 'ly') THEN 0 ELSE 1 END AS strength FROM g WHERE contains(p || ' ' || s, 'value') AND contains(p || ' ' || s, 'ly')),
d AS (SELECT *, specificity > 0 AND count(*) FILTER (specificity > 0) OVER (PARTITION BY dataset, measure, freq) > 3 AS by_dims FROM h),
v AS (SELECT *, NOT by_dims AND dataset IN ('asia', 'europe') AND seg <> 'all' AND count(*) FILTER (NOT by_dims AND seg <> 'all') OVER (PARTITION BY dataset, variant, dims, freq) >= 2 AS by_variant FROM d),
f AS (SELECT *, NOT by_dims AND NOT by_variant AND dataset = 'america' AND row_number() OVER (PARTITION BY dataset, measure, dims, by_dims OR by_variant ORDER BY CASE freq WHEN 'm' THEN 0 WHEN 'q' THEN 1 ELSE 2 END) > 1 AS by_freq FROM v),
x AS (SELECT *, CASE WHEN by_dims THEN 'dims' WHEN by_variant THEN 'variant' WHEN by_freq THEN 'freq' END AS axis, CASE WHEN by_dims THEN dataset || '.' || measure || '.' || freq WHEN by_variant THEN dataset || '.' || variant || '.' || dims || '.' || freq WHEN by_freq THEN dataset || '.' || measure || '.' || dims END AS family FROM f),
n AS (SELECT count(*) AS total, count(axis) AS in_families FROM x)"""


@query(
    f"""WITH {FOUND}, r AS (SELECT 'row' AS kind, NULL AS axis, series_id AS name, 1 AS members, series_id AS first, freq AS freqs FROM x WHERE axis IS NULL ORDER BY specificity, strength, legacy, dataset = 'europe', series_id LIMIT 20)
    SELECT z.*, total, least(total - in_families, 20) AS shown, total > least(total - in_families, 20) + in_families AS truncated FROM (SELECT * FROM r UNION ALL SELECT 'family', axis, family, count(*), min(series_id), array_to_string(list_sort(list(DISTINCT freq)), ',') FROM x WHERE axis IS NOT NULL GROUP BY axis, family) z, n"""
)
def series_find(spark, sf):
    return find.find(find_catalog(spark, sf), ["value", "ly"], AXES)


@query(
    f"""WITH {FOUND}, q AS (SELECT p || ' ' || s AS t, dataset = 'asia' AND variant = 'count' AS inside FROM g)
    SELECT word, count(*) FILTER (contains(t, word) AND inside) AS n, count(*) FILTER (contains(t, word)) AS n_unfiltered, 'fewer_words' AS hint FROM q, (VALUES ('value'), ('annual'), ('daily')) AS w(word) GROUP BY word"""
)
def find_diagnosis(spark, sf):
    return find.diagnosis(find_catalog(spark, sf), ["value", "annual", "daily"], ["count"], dataset="asia")
