"""Quotes of benchmark texts in documents, and of turns in their conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import quotes as qt
from quillstone.plans.adapters import table
from quillstone.plans.catalog import query

PLAIN = lambda c: f"regexp_replace({c}, '\\s', '', 'g')"


@query(f"""WITH l AS (SELECT item_id, unnest(string_split_regex(text, '[.,\\n]')) AS line, generate_subscripts(string_split_regex(text, '[.,\\n]'), 1) AS pos FROM benchmark),
    f AS (SELECT item_id, pos, {PLAIN('line')} AS fragment FROM l WHERE length({PLAIN('line')}) >= 10), u AS (SELECT doc_id, {PLAIN('text')} AS body FROM documents),
    h AS (SELECT needle, min(doc_id) AS doc_id FROM (SELECT DISTINCT left(fragment, 40) AS needle FROM f) JOIN u ON contains(body, needle) GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT item_id, doc_id, fragment, row_number() OVER (PARTITION BY item_id ORDER BY length(fragment) DESC, pos) AS rn FROM f JOIN h ON needle = left(fragment, 40))
    SELECT b.item_id AS quote_id, doc_id AS unit_id, CASE WHEN doc_id IS NULL THEN 'none' ELSE 'fragment' END AS how, fragment FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND rn = 1""")
def quote_documents(spark, sf):
    """The document that alone holds a piece of a benchmark text, the longest piece first."""
    none = lambda t: F.lit(None).cast(t)
    quotes = table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.split("text", "[.,\n]").alias("lines"), none("string").alias("speaker"), none("int").alias("page"), F.lit(0).alias("corpus"))
    units = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), "text", none("string").alias("speaker"), none("int").alias("page"), none("int").alias("end_page"), F.lit(0).alias("corpus"))
    return qt.find_units(quotes, units, ["corpus"]).select("quote_id", "unit_id", "how", "fragment")


@query(f"""WITH c AS (SELECT conv_id, turn, role, {PLAIN('text')} AS body, left({PLAIN("split_part(text, '.', 1)")}, 40) AS needle FROM conversations),
    n AS (SELECT a.conv_id, a.turn, count(*) AS n, min(conv.turn) AS hit FROM c a JOIN c conv ON conv.conv_id = a.conv_id AND length(a.needle) >= 10 AND contains(conv.body, a.needle) GROUP BY 1, 2),
    r AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN n = 1 THEN hit ELSE c.turn END AS unit, CASE WHEN n = 1 THEN 'fragment' ELSE 'speaker_on_page' END AS how FROM c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn)
    SELECT r.conv_id || ':' || r.turn AS quote_id, r.conv_id || ':' || unit AS unit_id, u.role AS speaker, how, CASE WHEN u.role = r.role THEN 'ok' ELSE 'wrong' END AS verdict FROM r JOIN c u ON u.conv_id = r.conv_id AND u.turn = unit""")
def quote_speakers(spark, sf):
    """Whose words the first sentence of each turn is, looked up in its conversation, against the role that said it."""
    c = table(spark, sf, "conversations").withColumn("id", F.concat("conv_id", F.lit(":"), "turn"))
    first = F.concat(F.lit("○"), "role", F.lit("【発言】"), F.substring_index("text", ".", 1))
    quotes = c.select(F.col("id").alias("quote_id"), "conv_id", F.array(first).alias("lines"), F.col("role").alias("speaker"), F.col("turn").cast("int").alias("page"))
    units = c.select(F.col("id").alias("unit_id"), "conv_id", "text", F.col("role").alias("speaker"), F.col("turn").cast("int").alias("page"), F.lit(None).cast("int").alias("end_page"))
    found = qt.find_units(quotes, units, ["conv_id"])
    return found.drop("fragment").join(qt.attribution(found, quotes.select("quote_id", "speaker")), "quote_id")
