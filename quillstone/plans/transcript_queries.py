"""Transcripts: records in eight forms made from the conversations, their lines, units and roles; page quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import transcripts as tr
from quillstone.operators.chunking import heading
from quillstone.plans.adapters import table
from quillstone.plans.catalog import query

#: Names of the forms' speakers, and the roles that they have at a meeting whose secretariat is the secretariat below.
SPEAKERS = ("奥野大臣官房審議官", "国家公安委員会委員長", "国土交通省(堤審議官)", "会計課事務局", "鈴木委員", "村岡構成員", "北町株式会社(島田部長)", "高市内閣総理大臣")
ROLES = ("ministry", "political", "ministry", "ministry", "member", "member", "external", "political")
LINES_PER_TURN = 100_000


def record_lines(spark, sf):
    """conv_id, line, page (the turn) and text: a list of those present and the chair's line, then each turn in its form.

    Forms by (conv_id + turn) mod 8: speech behind the name after the circle or the ideographic zero; a name alone; a
    party with a name in parentheses; a narration that names who speaks in the bullets below; a heading with bullets;
    written opinions; bullets of nobody in particular below such a heading; a name tight before its speech.
    """
    text = F.coalesce("text", F.lit(""))
    said = F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(t)), lambda t: t != "")
    name = F.element_at(F.array(*map(F.lit, SPEAKERS)), (F.col("form") + 1).cast("int"))
    bullets = F.transform("said", lambda t: F.concat(F.lit("・"), t))
    first = lambda mark: F.concat(F.array(F.concat(F.lit(mark), name, F.lit("　はい、"))), F.col("said"))
    lines = (
        F.when(F.col("form") == 0, first("○")).when(F.col("form") == 1, F.concat(F.array(F.concat(F.lit("〇"), name)), F.col("said")))
        .when(F.col("form") == 2, F.concat(F.array(F.concat(F.lit("○"), name)), bullets))
        .when(F.col("form") == 3, F.concat(F.array(F.lit("〇"), F.concat(name, F.lit("より、以下のとおり")), F.lit("発言があった。")), bullets))
        .when(F.col("form") == 4, F.concat(F.array(F.concat(F.lit("【"), name, F.lit("】"))), bullets))
        .when(F.col("form") == 5, F.concat(F.array(F.concat(F.lit("【提出者:"), name, F.lit("】"))), bullets))
        .when(F.col("form") == 6, F.concat(F.array(F.lit("【論点】")), bullets))
        .otherwise(F.concat(F.array(F.concat(F.lit("○"), name, F.lit("では、"))), F.col("said")))
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", said.alias("said"), ((F.col("conv_id") + F.col("turn")) % 8).alias("form"))
    body = turns.select("conv_id", "turn", F.posexplode(lines).alias("i", "text")).select("conv_id", ((F.col("turn") + 1) * LINES_PER_TURN + F.col("i")).alias("line"), F.col("turn").alias("page"), "text")
    opening = turns.select("conv_id").distinct().select("conv_id", F.posexplode(F.array(F.lit("出席者 鈴木委員"), F.lit("○山田座長"))).alias("i", "text"))
    return body.union(opening.select("conv_id", F.col("i").cast("long"), F.lit(0), "text"))


_TURNS = f"""t AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS form, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS said, {list(SPEAKERS)} AS names FROM conversations)"""
_UNITS = (
    "WITH " + _TURNS + """, u AS (
    SELECT conv_id, turn, 0 AS i, 'verbatim' AS mode, names[form + 1] AS speaker, CASE form WHEN 0 THEN 'はい、' WHEN 7 THEN 'では、' ELSE '' END || array_to_string(CASE WHEN form = 2 THEN list_transform(said, lambda x: '・' || x) ELSE said END, '') AS text FROM t WHERE form IN (0, 1, 2, 7)
    UNION ALL SELECT conv_id, turn, 0, 'narration', names[4], '会計課事務局より、以下のとおり発言があった。' FROM t WHERE form = 3
    UNION ALL SELECT conv_id, turn, 0, 'written', names[6], array_to_string(list_transform(said, lambda x: '・' || x), '') FROM t WHERE form = 5
    UNION ALL SELECT conv_id, turn, unnest(range(1, len(said) + 1)), CASE form WHEN 6 THEN 'anonymous' ELSE 'named' END, CASE WHEN form <> 6 THEN names[form + 1] END, unnest(said) FROM t WHERE form IN (3, 4, 6)),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS INTEGER) AS unit FROM u WHERE text <> '') """
)


def units(spark, sf):
    return tr.speech_units(record_lines(spark, sf), "conv_id", "line", "page", "text").filter("mode <> 'head'")


@query(_UNITS + "SELECT conv_id, unit, mode, speaker, CAST(turn AS INTEGER) AS start_page, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM n")
def transcript_units(spark, sf):
    return units(spark, sf).select("conv_id", "unit", "mode", "speaker", "start_page", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "WITH " + _TURNS + """, l AS (SELECT CASE form WHEN 0 THEN 'verbatim' WHEN 1 THEN 'alone' WHEN 2 THEN 'paren' WHEN 3 THEN 'narration' WHEN 7 THEN 'tight' ELSE 'heading' END AS form, 1 AS n FROM t
    UNION ALL SELECT 'text', 2 FROM t WHERE form = 3 UNION ALL SELECT CASE WHEN form IN (2, 3, 4, 5, 6) THEN 'bullet' ELSE 'text' END, len(said) FROM t
    UNION ALL SELECT unnest(['text', 'alone']), count(DISTINCT conv_id) FROM t) SELECT form, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1 HAVING sum(n) > 0"""
)
def transcript_lines(spark, sf):
    return record_lines(spark, sf).groupBy(tr.line_form(F.col("text")).alias("form")).agg(F.count("*").alias("n"))


@query(_UNITS + f"SELECT speaker, CASE WHEN speaker IS NULL THEN 'unknown' ELSE {list(ROLES)}[list_position({list(SPEAKERS)}, speaker)] END AS role, CASE WHEN speaker IS NOT NULL THEN CASE WHEN speaker = '北町株式会社(島田部長)' OR speaker IN ('鈴木委員', '村岡構成員') THEN 'third_party' ELSE 'government' END END AS licence, count(*) AS n FROM n GROUP BY 1")
def speaker_roles(spark, sf):
    role = tr.speaker_role(F.col("speaker"), tr.Meeting("規制会議", ("規制事務室",), hearing=True))
    counts = units(spark, sf).groupBy("speaker").agg(F.count("*").alias("n"))
    return counts.select("speaker", role.alias("role"), tr.licence_of(role).alias("licence"), "n")


@query(_UNITS + "SELECT conv_id, unit, '規制会議 第' || conv_id || '回（' || CASE WHEN conv_id % 2 = 0 THEN '2024-05-' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') ELSE '日付なし' END || '）' || CASE WHEN mode = 'narration' THEN '資料1 概要 p' || turn ELSE '議事録' END || '・' || coalesce(speaker, '不明') || '：' AS heading FROM n")
def unit_headings(spark, sf):
    day = F.concat(F.lit("2024-05-"), F.lpad((F.col("start_page") + 1).cast("string"), 2, "0"))
    kind = F.when(F.col("mode") == "narration", "page").otherwise("utterance")
    line = heading(kind, F.lit("規制会議"), F.col("conv_id"), F.when(F.col("conv_id") % 2 == 0, day), F.lit("議事録"), F.col("speaker"), F.lit("資料1"), F.lit("（案）概要"), F.col("start_page"))
    return units(spark, sf).select("conv_id", "unit", line.alias("heading"))


@query("SELECT CASE WHEN length(regexp_replace(regexp_replace(text, '(?m)^\\s*[-‐－]?\\s*[0-9０-９]{1,4}\\s*[-‐－]?\\s*$', '', 'g'), '\\s', '', 'g')) < 100 THEN 'sparse' ELSE 'full' END AS quality, count(*) AS n FROM documents GROUP BY 1")
def page_quality(spark, sf):
    return table(spark, sf, "documents").groupBy(tr.page_quality(F.col("text")).alias("quality")).agg(F.count("*").alias("n"))
