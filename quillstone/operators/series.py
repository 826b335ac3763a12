"""Time series: a catalogue (series_id and its parts) and values (series_id, period, region, value)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.periods import matches, parsed

from .retrieval import small

#: More values than this in one range are refused, never cut.
MAX_RANGE = 100


def point_lookup(requests: DataFrame, catalog: DataFrame, values: DataFrame) -> DataFrame:
    """requests (request, series_id, period, region) with value and reason: the exact value, or why there is none.

    request is unique. The values are read once, those of the series asked for alone.
    """
    asked = small(requests.select("request", "series_id", F.col("period").alias("p"), F.col("region").alias("r")))
    here = (F.col("period") == F.col("p")) & (F.col("region") == F.col("r"))
    found = values.join(asked, "series_id").groupBy("request").agg(
        F.min(F.struct("year", "sub")).alias("lo"), F.max(F.struct("year", "sub")).alias("hi"), F.bool_or(F.col("region") == F.col("r")).alias("has_region"), F.max(F.when(here, F.col("value"))).alias("value")
    )
    known = catalog.join(small(requests.select("series_id").distinct()), "series_id", "left_semi").select("series_id", "freq", "status")
    out = requests.join(known, "series_id", "left").join(found, "request", "left")
    p = parsed(F.col("period"))
    at = F.struct(p["year"].alias("year"), p["sub"].alias("sub"))
    reason = (
        F.when(F.col("freq").isNull(), "unknown_series").when(F.col("status") == "guide_only", "guide_only").when(~matches(F.col("period"), F.col("freq")), "period_format")
        .when(F.col("hi").isNull(), "no_values").when(~F.col("has_region"), "region_not_available").when(F.col("value").isNotNull(), None)
        .when(at > F.col("hi"), "not_published").when(at < F.col("lo"), "out_of_range").otherwise("missing")
    )
    return out.select("request", "series_id", "period", "region", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))


def range_lookup(requests: DataFrame, values: DataFrame, most: int = MAX_RANGE) -> DataFrame:
    """requests (request, series_id, lo, hi period texts) with each value from lo to hi; too wide a range is one row with a reason."""
    lo, hi = parsed(F.col("lo")), parsed(F.col("hi"))
    r = requests.withColumns({"a": lo["year"] * 10000 + lo["sub"], "b": hi["year"] * 10000 + hi["sub"]}).alias("r")
    v = values.withColumn("at", F.col("year") * 10000 + F.col("sub")).alias("v")
    hit = r.join(v, (F.col("r.series_id") == F.col("v.series_id")) & F.col("v.at").between(F.col("r.a"), F.col("r.b"))).select("request", "r.series_id", "period", "value", "at")
    n = F.count("*").over(Window.partitionBy("request"))
    hit = hit.withColumn("n", n)
    fine = hit.filter(F.col("n") <= most).select("request", "series_id", "period", "value", F.lit(None).cast("string").alias("reason"))
    wide = hit.filter(F.col("n") > most).groupBy("request", "series_id").agg(F.lit("range_too_wide").alias("reason")).select("request", "series_id", F.lit(None).cast("string").alias("period"), F.lit(None).cast("double").alias("value"), "reason")
    return fine.union(wide)


def break_hits(requests: DataFrame, breaks: DataFrame) -> DataFrame:
    """Breaks with lo < period <= hi (as texts) of the same measure."""
    return requests.join(small(breaks), "measure").filter((F.col("lo") < F.col("break_period")) & (F.col("break_period") <= F.col("hi")))


def search(catalog: DataFrame, words: list[str], primary: list[str], secondary: list[str]) -> DataFrame:
    """Series with all words: strength 0 if the primary text has them, 1 if both texts together do; few dimensions first."""
    first = F.lower(F.concat_ws(" ", *primary))
    both = F.concat_ws(" ", first, F.lower(F.concat_ws(" ", *secondary)))
    inside = lambda text: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    out = catalog.withColumn("strength", F.when(inside(first), 0).when(inside(both), 1)).filter("strength IS NOT NULL")
    return out.orderBy("specificity", "strength", "series_id")


def collapsed(rows: DataFrame, family: list[str], more_than: int) -> DataFrame:
    """Families of more than so many members become one card with their number; the others stay single."""
    n = F.count("*").over(Window.partitionBy(*family))
    out = rows.withColumn("n", n)
    single = out.filter(F.col("n") <= more_than).select("series_id", F.lit(1).cast("long").alias("members"), F.lit("row").alias("kind"))
    card = out.filter(F.col("n") > more_than).groupBy(*family).agg(F.min("series_id").alias("series_id"), F.count("*").alias("members")).select("series_id", "members", F.lit("card").alias("kind"))
    return single.union(card)


def finest(rows: DataFrame, family: list[str], order: dict[str, int]) -> DataFrame:
    """Of each family the row with the finest frequency."""
    rank = F.create_map(*(F.lit(x) for p in order.items() for x in p))[F.col("freq")]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*family).orderBy(rank, "series_id"))).filter("_r = 1").drop("_r")


def coverage(catalog: DataFrame, value: str, other: str, within: list[str]) -> DataFrame:
    """Values that come with the same set of others: one row a set."""
    sets = catalog.groupBy(*within, value).agg(F.array_join(F.sort_array(F.collect_set(other)), ",").alias("others"))
    return sets.groupBy(*within, "others").agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias("values"), F.count("*").alias("n"))


def dispersion(values: DataFrame, least: int = 8) -> DataFrame:
    """Robust dispersion of log differences: 1.4826 times the median absolute deviation, with upper medians; positives only."""
    w = Window.partitionBy("series_id", "region").orderBy("year", "sub")
    d = values.filter("value > 0").withColumn("d", F.log("value") - F.log(F.lag("value").over(w))).filter("d IS NOT NULL")
    upper = lambda xs: F.element_at(F.array_sort(xs), (F.floor(F.size(xs) / 2) + 1).cast("int"))
    g = d.groupBy("series_id", "region").agg(F.collect_list("d").alias("ds")).filter(F.size("ds") >= least)
    return g.withColumn("m", upper(F.col("ds"))).select("series_id", "region", F.size("ds").alias("n"), F.round(1.4826 * upper(F.transform("ds", lambda x: F.abs(x - F.col("m")))), 4).alias("dispersion"))


#: What a name in a pattern may stand for: these have no hyphen (fixed values), all others may.
PLAIN_NAMES = ("industry", "measure", "dataset", "org")


def expanded(catalog: DataFrame, pattern: str, dims: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(series_id and a column for each name, dim and slug of wishes that no series has).

    pattern is a series_id with {names}; only registered series come out, never combinations that don't exist. A name
    without wishes stands for all that there is.
    """
    names = re.findall(r"\{([a-z_]+)\}", pattern)
    if not names:
        return catalog.filter(F.col("series_id") == pattern).select("series_id"), catalog.sparkSession.createDataFrame([], "dim string, slug string")
    parts = re.split(r"\{[a-z_]+\}", pattern)
    regex = "^" + "".join(re.escape(fixed) + (f"([a-z0-9_{'' if n in PLAIN_NAMES else '-'}]+)" if n else "") for fixed, n in zip(parts, [*names, ""])) + "$"
    fits = catalog.filter(F.col("series_id").rlike(regex)).select("series_id", *(F.regexp_extract("series_id", regex, i).alias(n) for i, n in enumerate(names, 1)))
    out = fits
    for n in names:
        if dims.get(n):
            out = out.filter(F.col(n).isin(dims[n]))
    wishes = [(n, v) for n in names for v in dims.get(n) or []]
    asked = catalog.sparkSession.createDataFrame(wishes, "dim string, slug string")
    seen = fits.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dim"), F.col(n).alias("slug")) for n in names))).alias("s")).select("s.*").distinct()
    return out, asked.join(seen, ["dim", "slug"], "left_anti")


def ordered_union(lists: list[DataFrame]) -> DataFrame:
    """series_id, place: each id once, where it first comes in the lists (series_id, place) one after another."""
    rows = reduce(DataFrame.union, (x.select("series_id", F.struct(F.lit(n).alias("list"), "place").alias("at")) for n, x in enumerate(lists)))
    first = rows.groupBy("series_id").agg(F.min("at").alias("at"))
    # a panel has few series: its limit is checked before it is numbered
    return first.withColumn("place", F.row_number().over(Window.orderBy("at"))).select("series_id", "place")


def quality_groups(series: DataFrame, columns: list[str]) -> DataFrame:
    """The signature's columns, quality (q1, q2, ... in the order of each group's first series) and its number of series."""
    groups = series.groupBy(*columns).agg(F.min("series_id").alias("first"), F.count("*").alias("n"))
    return groups.select(*columns, F.concat(F.lit("q"), F.row_number().over(Window.orderBy("first"))).alias("quality"), "n")


def basis_groups(series: DataFrame, label: str) -> DataFrame:
    """label, n, mixed: the panel's period bases; mixed if there is more than one, as such values can't be put side by side."""
    groups = series.groupBy(label).agg(F.count("*").alias("n"))
    return groups.withColumn("mixed", F.count("*").over(Window.partitionBy(F.lit(1))) > 1)


def factored(series: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and for each column its value where all the key's series share one, else null: what is said once for a source."""
    same = [F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in columns]
    return series.groupBy(key).agg(*same, F.count("*").alias("n"))


def token_hits(catalog: DataFrame, words: list[str], texts: list[str]) -> DataFrame:
    """token, n: how many series have each word by itself."""
    text = F.lower(F.concat_ws(" ", *texts))
    one = catalog.agg(*(F.count_if(F.contains(text, F.lit(w.lower()))).alias(f"n{i}") for i, w in enumerate(words)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(w).alias("token"), F.col(f"n{i}").alias("n")) for i, w in enumerate(words)))).alias("s")).select("s.*")


def faceted(catalog: DataFrame, tags: list[str] | None = None, **facets: str | list[str] | None) -> DataFrame:
    """All given facets together: tags that share one with the series', other columns that are among the values."""
    out = catalog.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else catalog
    for name, wanted in facets.items():
        if wanted:
            out = out.filter(F.col(name).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    return out


#: A dispersion from here on that is so many times its aggregate's is volatile; fewer members make a small cell.
VOLATILE, TIMES, SMALL = 0.15, 2.0, 100


def volatile(dispersion: DataFrame, parents: DataFrame, least: float = VOLATILE, ratio: float = TIMES) -> DataFrame:
    """series_id, dispersion, parent's dispersion, volatile: much, and much more than its aggregate (to two decimals)."""
    p = dispersion.select(F.col("series_id").alias("parent"), F.col("dispersion").alias("parent_dispersion"))
    both = dispersion.join(parents, "series_id").join(p, "parent")
    times = F.round(F.col("dispersion") / F.nullif("parent_dispersion", F.lit(0.0)), 2)
    return both.select("series_id", "parent", "dispersion", "parent_dispersion", F.coalesce((F.col("dispersion") >= least) & (times >= ratio), F.lit(False)).alias("volatile"))


def cell_flags(flags: DataFrame, population: DataFrame, fewer: float = SMALL) -> DataFrame:
    """series_id and flags (volatile, small_cell, comma-joined) of the series that have one.

    flags is volatile()'s result; population has series_id, at and value: a series' newest value counts its members.
    Series in one of the two alone are judged by what there is.
    """
    newest = population.filter("value IS NOT NULL").groupBy("series_id").agg(F.max_by("value", "at").alias("members"))
    both = flags.select("series_id", "volatile").join(newest, "series_id", "full")
    marks = F.concat_ws(",", F.when(F.col("volatile"), "volatile"), F.when(F.col("members") < fewer, "small_cell"))
    return both.select("series_id", marks.alias("flags")).filter("flags <> ''")


def id_parts(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """series_id, org, dataset, measure, dims, freq: ids taken apart by the shapes that registered series have.

    catalog has series_id, org, dataset, measure, dims and freq. An id begins with org and dataset, then comes a measure,
    which may hold dots, then the dims, then what follows them in a registered id of that measure. The longest measure
    that fits wins, and then the longest ending; an id that fits none has nulls.
    """
    dot, empty = F.lit("."), F.lit("")
    tail = F.expr("substr(series_id, length(concat_ws('.', org, dataset, measure, dims)) + 1)")
    shapes = catalog.select(F.concat_ws(".", "org", "dataset").alias("start"), "org", "dataset", "measure", tail.alias("ending"), "freq").distinct()
    asked = ids.select("series_id").distinct().withColumns({"start": F.substring_index("series_id", ".", 2), "rest": F.expr("substr(series_id, length(substring_index(series_id, '.', 2)) + 2)")})
    fits = F.startswith("rest", F.concat("measure", dot)) & F.endswith("rest", "ending") & (F.length("rest") >= F.length("measure") + F.length("ending"))
    dims = F.expr("substr(rest, length(measure) + 2, length(rest) - length(measure) - 1 - length(ending))")
    found = asked.join(small(shapes), "start").filter(fits).withColumn("dims", F.coalesce(dims, empty))
    best = found.groupBy("series_id").agg(F.max_by(F.struct("org", "dataset", "measure", "dims", "freq"), F.struct(F.length("measure"), F.length("ending"))).alias("best"))
    return asked.select("series_id").join(best, "series_id", "left").select("series_id", "best.*")
