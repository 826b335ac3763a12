"""Finding series: all words, families in place of their many members by three axes in order, totals, and why nothing was found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import faceted

#: More members than these make a family by dimensions; frequencies from the finest.
THRESHOLD = 3
FREQS = ("d", "m", "q", "fq", "h", "fy", "a", "irr")


@dataclass(frozen=True)
class Axes:
    """Which data sets grow along other axes than their dimensions."""

    #: Data sets whose measures are an item and a variant, joined by an underscore: the items in question, and the whole's.
    variant_datasets: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    whole: str = "gdp"
    #: Data sets with the same measure at several frequencies.
    freq_datasets: tuple[str, ...] = ()


def with_legacy(catalog: DataFrame) -> DataFrame:
    """catalog with legacy: the data set has a superseded series, so that all of it goes last."""
    old = catalog.groupBy("dataset").agg(F.max(F.coalesce(F.col("superseded_by"), F.lit("")) != "").alias("legacy"))
    return catalog.join(old, "dataset")


def hits(catalog: DataFrame, words: list[str]) -> DataFrame:
    """catalog with strength: 0 if title, series_id and measure have all words, 1 if notes and names of tables help."""
    primary = F.lower(F.concat_ws(" ", "title", "series_id", "measure"))
    secondary = F.lower(F.concat_ws(" ", "notes", "stat_name", "table_title"))
    every = lambda *texts: F.forall(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.exists(F.array(*texts), lambda t: F.contains(t, w))) if words else F.lit(True)
    return catalog.withColumn("strength", F.when(every(primary), 0).when(every(primary, secondary), 1)).filter("strength IS NOT NULL")


def collapsed_by(rows: DataFrame, axes: Axes, expand: bool, freq_asked: bool) -> DataFrame:
    """rows with axis: dims, variant or freq where a family stands for the series, else null; family names it.

    In order: series with detail (specificity above 0) of one data set, measure and frequency, if more than THRESHOLD;
    then the items but the whole of one variant, dimensions and frequency, if two at least; then all but the finest
    frequency of one measure and dimensions. What one axis took is no member for the next. expand (dimensions were asked
    for) collapses nothing, freq_asked nothing by frequency.
    """
    if expand:
        return rows.withColumn("axis", F.lit(None).cast("string")).withColumn("family", F.lit(None).cast("string"))
    dims = ["dataset", "measure", "freq"]
    n = F.count_if(F.col("specificity") > 0).over(Window.partitionBy(*dims))
    out = rows.withColumn("_dims", (F.col("specificity") > 0) & (n > THRESHOLD))
    # the longest item that the measure begins with
    item = F.lit(None).cast("string")
    for i in sorted(axes.items, key=len):
        item = F.when(F.startswith(F.col("measure"), F.lit(f"{i}_")), F.lit(i)).otherwise(item)
    # null where this axis has no say, so that such rows are in no group of it
    out = out.withColumn("_item", F.when(F.col("dataset").isin(list(axes.variant_datasets)) & ~F.col("_dims"), item))
    out = out.withColumn("_variant", F.expr("substring(measure, length(_item) + 2)"))
    part = (F.col("_item") != axes.whole).cast("int")
    n = F.sum(part).over(Window.partitionBy("dataset", "_variant", "dims", "freq"))
    out = out.withColumn("_variants", F.coalesce((part == 1) & (n >= 2), F.lit(False)))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, FREQS)), F.col("freq")), F.lit(0))
    rank = F.when(rank == 0, len(FREQS) + 1).otherwise(rank)
    open_ = F.col("dataset").isin(list(axes.freq_datasets)) & ~F.col("_dims") & ~F.col("_variants") & F.lit(not freq_asked)
    # rows that have no say stand in groups apart
    finest = F.row_number().over(Window.partitionBy("dataset", "measure", "dims", open_).orderBy(rank, "series_id"))
    out = out.withColumn("_freqs", open_ & (finest > 1))
    axis = F.when(F.col("_dims"), "dims").when(F.col("_variants"), "variant").when(F.col("_freqs"), "freq")
    family = F.when(axis == "dims", F.concat_ws(".", *dims)).when(axis == "variant", F.concat_ws(".", "dataset", "_variant", "dims", "freq")).when(axis == "freq", F.concat_ws(".", "dataset", "measure", "dims"))
    return out.withColumn("axis", axis).withColumn("family", family).drop("_dims", "_item", "_variant", "_variants", "_freqs")


def find(catalog: DataFrame, words: list[str], axes: Axes = Axes(), limit: int = 20, expand: bool = False, tags: list[str] | None = None, **facets) -> DataFrame:
    """kind, axis, name, members, first, freqs, total, shown, truncated: the first rows, all families, and the totals beside both.

    catalog: series_id, dataset, measure, dims, freq, specificity, title, notes, stat_name, table_title, scope,
    superseded_by, tags, first_period. A row is a series by itself (name is its id), in the order of specificity,
    strength, legacy data sets last, international last, id; limit is cut to 1 to 50. A family has its number of members,
    the least id and all frequencies of its members. truncated: some series is neither shown nor in a family.
    """
    found = hits(faceted(with_legacy(catalog), tags, **facets), words)
    told = collapsed_by(found, axes, expand, bool(facets.get("freq")))
    count = told.agg(F.count("*").alias("total"), F.count("axis").alias("in_families"))
    order = ["specificity", "strength", "legacy", F.col("scope") == "intl", "series_id"]
    limit = max(1, min(limit, 50))
    none = F.lit(None).cast("string")
    rows = told.filter("axis IS NULL").orderBy(*order).limit(limit).select(F.lit("row").alias("kind"), none.alias("axis"), F.col("series_id").alias("name"), F.lit(1).cast("long").alias("members"), F.col("series_id").alias("first"), F.col("freq").alias("freqs"))
    families = told.filter("axis IS NOT NULL").groupBy("axis", "family").agg(F.count("*").alias("members"), F.min("series_id").alias("first"), F.array_join(F.array_sort(F.collect_set("freq")), ",").alias("freqs"))
    out = rows.union(families.select(F.lit("family"), "axis", "family", "members", "first", "freqs"))
    shown = F.least(F.col("total") - F.col("in_families"), F.lit(limit))
    return out.crossJoin(F.broadcast(count)).select("kind", "axis", "name", "members", "first", "freqs", "total", shown.alias("shown"), (F.col("total") > shown + F.col("in_families")).alias("truncated"))


def diagnosis(catalog: DataFrame, words: list[str], tags: list[str] | None = None, **facets) -> DataFrame:
    """word, n, n_unfiltered, hint: how many series each word meets by itself, with the facets and without, in one pass.

    hint says why all words together meet nothing: fewer_words if there are several and some meet series by themselves,
    other_facets if the facets took away what the words would meet, else not_held.
    """
    used = bool(tags) or any(facets.values())
    inside: Column = F.lit(True)
    if tags:
        inside &= F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    for name, wanted in facets.items():
        if wanted:
            inside &= F.col(name).isin([wanted] if isinstance(wanted, str) else list(wanted))
    text = F.lower(F.concat_ws(" ", "title", "series_id", "measure", "notes", "stat_name", "table_title"))
    inside = F.coalesce(inside, F.lit(False))
    meets = [F.contains(text, F.lit(w.lower())) for w in words]
    one = catalog.agg(*(F.count_if(m & inside).alias(f"n{i}") for i, m in enumerate(meets)), *(F.count_if(m).alias(f"u{i}") for i, m in enumerate(meets)))
    each = F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("n_unfiltered")) for i, w in enumerate(words)))
    hint = F.when(F.lit(len(words) > 1) & F.exists(each, lambda s: s.n > 0), "fewer_words").when(F.lit(used) & F.exists(each, lambda s: s.n_unfiltered > 0), "other_facets").otherwise("not_held")
    return one.select(F.explode(each).alias("s"), hint.alias("hint")).select("s.*", "hint")
