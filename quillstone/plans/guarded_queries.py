"""What a guarded write counts, and a registry of parts written with a shared table and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.plans.adapters import table
from quillstone.plans.catalog import query
from quillstone.sources import guarded
from quillstone.sources.shared import shared_path


@query("""WITH d AS (SELECT *, n_chars >= 500 AS kept, coalesce(lang = 'en', false) AS en FROM documents)
    SELECT count(*) FILTER (kept) AS both, count(*) FILTER (NOT kept) AS only_old, 0 AS only_new, 0 AS repeated, count(*) FILTER (kept AND en AND text IS NOT NULL) AS texts, count(*) FILTER (kept AND NOT en AND upper(source) <> source) AS fields FROM d""")
def metadata_changes(spark, sf):
    """Documents against a version without the short ones, with a mark behind English texts and the other sources in capitals."""
    old = table(spark, sf, "documents")
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    new = old.filter("n_chars >= 500").withColumns({"text": F.when(en, F.concat("text", F.lit("."))).otherwise(F.col("text")), "source": F.when(en, F.col("source")).otherwise(F.upper("source"))})
    return guarded.changes(old, new, "doc_id", "text")


@query("SELECT p_brand AS brand, p_type AS kind, count(*) AS n, min(p_name) AS first_name, max(p_size) AS greatest FROM part GROUP BY 1, 2")
def part_registry(spark, sf):
    """Parts by brand and kind, read from a registry whose brands and kinds stand in a shared table."""
    root, columns = shared_path(spark, "parts"), ["p_brand", "p_type"]
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", *columns)
    guarded.write_registry(rows, root, "v1", columns, [("key", F.col("p_partkey").isNotNull()), ("size", F.col("p_size") > 0)])
    out = guarded.read_registry(spark, root, columns)
    return out.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"), F.max("p_size").alias("greatest"))
