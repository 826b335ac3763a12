"""Quotes looked up in units of text: the longest fragment that stands in exactly one unit, else the place that the quote names."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import small

# A fragment's least length, how much of it is compared, marks before it, headings before it.
LEAST, COMPARED = 10, 40
MARKS, HEADING = "^[○〇・･]", r"^【[^】]*】|^\([^()]{1,30}\)"
#: Lengths for which seeds are made; a fragment uses the greatest that it reaches.
CLASSES = (40, 20, 10)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _plain(text: str | None) -> str:
    return "".join(unicodedata.normalize("NFKC", text).split()) if text else ""


@F.pandas_udf(T.StringType())
def plain(s: pd.Series) -> pd.Series:
    """NFKC without white space; null is empty."""
    return s.map(_plain)


def window_seeds(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, seed): the least hash of the runs of width / 2 characters in every window of width characters, each once a text.

    It depends on the window alone: a text that holds a window has its seed, and a text has far fewer than windows. The
    texts are hashed in one run, and windows that cross from one to the next are left out.
    """
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run = width // 2
    h = np.zeros(len(code) - run + 1, np.uint64)
    for i in range(run):
        h = h * np.uint64(1000003) + code[i : i + len(h)]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h ^= h >> np.uint64(32)
    least = np.lib.stride_tricks.sliding_window_view(h, width - run + 1).min(axis=1).view(np.int64)
    ends = np.cumsum(list(map(len, texts)))
    text = np.searchsorted(ends, np.arange(len(least)), "right")
    inside = np.arange(len(least)) + width <= ends[text]
    least, text = least[inside], text[inside]
    order = np.lexsort((least, text))
    least, text = least[order], text[order]
    new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))[: len(least)]
    return text[new], least[new]


#: Texts that are normalised and cut into windows at once.
TEXTS = 256


def seeded(units: DataFrame, keys: list[str], whole_texts: bool = False) -> DataFrame:
    """unit_id, keys, width, seed of each text's windows of every class: one pass in one worker, few texts at a time.

    whole_texts: a text is one window, and has the seed of the class of its length alone.
    """
    head = units.select("unit_id", *keys)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                bodies = [_plain(t.as_py()) for t in batch.column(batch.num_columns - 1)]
                for width in CLASSES:
                    row, found = window_seeds([t if len(t) == width or not whole_texts else "" for t in bodies], width)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[:-1]), pa.array(np.full(len(found), width, np.int32)), pa.array(found)], [*batch.schema.names[:-1], "width", "seed"])

    schema = T.StructType([*head.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("seed", T.LongType())])
    return units.select("unit_id", *keys, F.col("text").cast("string")).mapInArrow(run, schema)


def fragments(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """quote_id, keys, rank (1: the longest; of equals the first line), fragment, needle (what is compared of it)."""
    line = quotes.select("quote_id", *keys, plain(F.coalesce("speaker", F.lit(""))).alias("_who"), F.posexplode("lines").alias("pos", "line")).withColumn("f", F.regexp_replace(plain(F.col("line")), MARKS, ""))
    named = (F.col("_who") != "") & F.startswith("f", "_who")
    line = line.withColumn("f", F.regexp_replace(F.when(named, F.substr("f", F.length("_who") + 1)).otherwise(F.col("f")), HEADING, "")).filter(F.length("f") >= LEAST)
    order = Window.partitionBy("quote_id").orderBy(F.length("f").desc(), "pos")
    return line.select("quote_id", *keys, F.row_number().over(order).alias("rank"), F.col("f").alias("fragment"), F.substring("f", 1, COMPARED).alias("needle"))


def needle_hits(needles: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, needle, n, unit_id (the smallest): in how many units with the keys each needle stands.

    Units give their seeds, and only those that a needle has go on: the texts move once, to the units hit, where the
    needle is looked for in full. Every needle meets every unit that holds it, however common.
    """
    long = F.length("needle")
    width = reduce(lambda out, c: out.when(long >= c, c), CLASSES[1:], F.when(long >= CLASSES[0], CLASSES[0]))
    ours = needles.select(*keys, "needle").distinct().withColumn("width", width).filter("width IS NOT NULL")
    ours = seeded(ours.select(F.col("needle").alias("unit_id"), *keys, F.expr("substring(needle, 1, width)").alias("text")), keys, True).withColumnRenamed("unit_id", "needle")
    pairs = seeded(units, keys).join(small(ours), [*keys, "width", "seed"]).select("unit_id", *keys, "needle")
    body = units.select("unit_id", plain(F.col("text")).alias("body"))
    held = body.join(pairs, "unit_id").filter(F.contains("body", "needle"))
    return held.groupBy(*keys, "needle").agg(F.count("*").alias("n"), F.min("unit_id").alias("unit_id"))


def find_units(quotes: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """quote_id, unit_id, speaker, how, fragment: the unit with a quote, among the units of its keys.

    quotes has quote_id (unique), keys, lines, speaker and page; units has unit_id (unique), keys, text, speaker, page
    and end_page. how: fragment (the longest that exactly one unit holds), speaker_on_page (the first unit on the quote's
    page by its speaker), page (the first unit on the page; its speaker is all that the page has, as it stays open), or
    none. Lines of fewer than ten characters name nothing; a quote without a page or speaker has no second way.
    """
    parts = fragments(quotes, keys)
    hits = needle_hits(parts, units, keys).filter("n = 1").select(*keys, "needle", "unit_id")
    best = parts.join(hits, [*keys, "needle"]).groupBy("quote_id").agg(F.min_by(F.struct("unit_id", "fragment"), "rank").alias("hit"))
    rest = quotes.filter("page IS NOT NULL AND speaker <> ''").join(best, "quote_id", "left_anti").select("quote_id", *keys, F.col("page").alias("_page"), plain(F.col("speaker")).alias("_who"))
    here = units.select("unit_id", *keys, "speaker", plain(F.col("speaker")).alias("who"), "page", F.coalesce("end_page", "page").alias("end"))
    # a page is met by equal numbers: a unit counts on each page that it covers
    here = here.withColumn("_page", F.explode(F.sequence("page", F.greatest("end", "page"))))
    on = rest.join(here, [*keys, "_page"]).groupBy("quote_id").agg(
        F.min(F.when(F.col("who") == F.col("_who"), F.struct("unit_id", "speaker"))).alias("same"), F.min("unit_id").alias("first"), F.array_join(F.array_sort(F.collect_set("speaker")), "／").alias("all"))
    names = units.select("unit_id", F.col("speaker").alias("_speaker"))
    out = quotes.select("quote_id").join(best, "quote_id", "left").join(on, "quote_id", "left")
    out = out.withColumn("unit_id", F.coalesce("hit.unit_id", "same.unit_id", "first")).join(names, "unit_id", "left")
    how = F.when(F.col("hit").isNotNull(), "fragment").when(F.col("same").isNotNull(), "speaker_on_page").when(F.col("first").isNotNull(), "page").otherwise("none")
    return out.select("quote_id", "unit_id", F.when(how == "page", F.col("all")).otherwise(F.col("_speaker")).alias("speaker"), how.alias("how"), F.col("hit.fragment").alias("fragment"))


def attribution(found: DataFrame, labels: DataFrame, unknown: str = "不明") -> DataFrame:
    """quote_id, verdict of labels (quote_id, speaker; null: anonymous) against found: ok, unknown, wrong, named_anonymous or no_unit.

    A speaker left unknown is no mistake; another one is, and so is any name for an anonymous quote.
    """
    both = labels.select("quote_id", F.col("speaker").alias("want")).join(found, "quote_id", "left")
    same, open_ = plain(F.coalesce("speaker", F.lit(""))) == plain(F.coalesce("want", F.lit(""))), F.coalesce("speaker", F.lit("")).isin("", unknown)
    verdict = F.when(F.col("unit_id").isNull(), "no_unit").when(F.col("want").isNull(), F.when(open_, "ok").otherwise("named_anonymous")).when(same, "ok").when(open_, "unknown").otherwise("wrong")
    return both.select("quote_id", verdict.alias("verdict"))

