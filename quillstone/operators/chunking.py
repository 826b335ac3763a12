"""Semantic chunks: texts cut where neighbouring sentences' vectors are far apart, and capped in size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import bounded_parts, fixed_chunks

#: The percentile of a document's distances beyond which it is cut, and decimals by which distances differ.
PERCENTILE, DECIMALS = 0.95, 9


@F.arrow_udf(T.DoubleType())
def cosine_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """1 - cosine of two vectors of numbers; null if either is null or has no length, a null in it or another number of dimensions."""
    sizes = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    usable = (sizes > 0) & (sizes == pc.fill_null(pc.list_value_length(b), -1).to_numpy(zero_copy_only=False))
    out, known = np.zeros(len(a)), np.zeros(len(a), bool)
    for size in np.unique(sizes[usable]):
        at = np.flatnonzero(usable & (sizes == size))
        x, y = (v.take(pa.array(at)).flatten() for v in (a, b))
        whole = ~(x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)).reshape(-1, size).any(1)
        x, y = (np.ascontiguousarray(v.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size).T) for v in (x, y))
        # dimension by dimension: the sums are those of a plain loop, whatever stands beside them
        xx, yy, xy = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
        for u, v in zip(x, y):
            xx, yy, xy = xx + u * u, yy + v * v, xy + u * v
        length = np.sqrt(xx) * np.sqrt(yy)
        whole &= length != 0
        out[at[whole]], known[at[whole]] = 1.0 - xy[whole] / length[whole], True
    return pa.array(out, mask=~known)


def breakpoints(sentences: DataFrame, doc: str, order: str, vector: str, percentile: float = PERCENTILE) -> DataFrame:
    """sentences with distance to the sentence after (null at the end) and cut: the distance is above the document's percentile.

    The percentile lies between two neighbours in the order of the document's distances, in proportion. Both are found by
    their places in that order, in windows over the document that spill: sentences are moved once, and no task holds a
    document's distances. Distances that differ by less than 1e-9 are equal.
    """
    mine = Window.partitionBy(doc)
    out = sentences.withColumn("_after", F.lead(vector).over(mine.orderBy(order)))
    out = out.withColumn("distance", F.round(cosine_distance(F.col(vector), F.col("_after")), DECIMALS)).drop(vector, "_after")
    out = out.withColumns({"_place": F.row_number().over(mine.orderBy(F.col("distance").asc_nulls_last())) - 1, "_at": F.lit(percentile) * (F.count("distance").over(mine) - 1)})
    near = F.when((F.col("_place") == F.floor("_at")) | (F.col("_place") == F.ceil("_at")), F.col("distance"))
    out = out.withColumns({"_low": F.min(near).over(mine), "_high": F.max(near).over(mine)})
    limit = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return out.withColumn("cut", F.coalesce(F.col("distance") > limit + 10.0 ** -(DECIMALS + 3), F.lit(False))).drop("_place", "_at", "_low", "_high")


def semantic_chunks(sentences: DataFrame, doc: str, order: str, text: str, vector: str, limit: int, percentile: float = PERCENTILE) -> DataFrame:
    """doc, chunk, part, text, first, last: runs of sentences between breakpoints, in parts of at most limit characters.

    vector is the embedding of the sentence (or of its surroundings); order is unique in a document. Chunks are numbered
    from 0; first and last are the chunk's sentences. A chunk beyond the limit is divided at sentences, and a sentence
    beyond it at the limit. Documents of one sentence, or without usable vectors, are one chunk. Null texts count as
    empty, and parts without text are left out. A row holds one chunk, which is no longer than its document.
    """
    marked = breakpoints(sentences.withColumn(text, F.coalesce(text, F.lit(""))), doc, order, vector, percentile)
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("chunk", F.coalesce(F.sum(F.col("cut").cast("int")).over(before), F.lit(0)))
    runs = marked.groupBy(doc, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(text).alias("t")))).alias("run"), F.min(order).alias("first"), F.max(order).alias("last"))
    cut = lambda s: F.when(F.length(s.t) <= limit, F.array(s.t)).otherwise(F.filter(fixed_chunks(s.t, limit, 0), lambda p: p != ""))
    pieces = F.flatten(F.transform(F.filter("run", lambda s: s.t != ""), cut))
    # outer, so that the parts are not made again to see whether there are any
    return runs.select(doc, "chunk", "first", "last", F.posexplode_outer(bounded_parts(pieces, limit)).alias("part", "text")).filter("part IS NOT NULL")


def heading(unit: Column, org: Column, session: Column, date: Column, kind: Column, who: Column, material: Column, title: Column, page: Column) -> Column:
    """What stands before a unit's text in the index: body, session and date, then the record's kind or the page, and who.

    unit is utterance or page. Of a page's title only what follows the first closing bracket counts, if there is one.
    Fixed values: the words between the parts, and what stands for a missing date or an unknown person.
    """
    where = F.concat(org, F.lit(" 第"), session.cast("string"), F.lit("回（"), F.when(F.coalesce(date, F.lit("")) == "", "日付なし").otherwise(date), F.lit("）"))
    rest = F.when(F.contains(title, F.lit("）")), F.regexp_replace(title, "^[^）]*）", "")).otherwise(title)
    named = F.concat_ws(" ", F.when(material != "", material), F.when(rest != "", rest))
    name = F.coalesce(who, F.lit("不明"))
    return F.concat(where, F.when(unit == "page", F.concat(named, F.lit(" p"), page.cast("string"))).otherwise(kind), F.lit("・"), name, F.lit("："))
