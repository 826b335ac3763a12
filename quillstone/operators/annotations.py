"""Quality of series: breaks within and around an asked range, cautions, and their summary over a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join, point_join

#: Bits of a period's digits, at most YYYYMMDD.
BITS = 25
#: Fixed value: the kind of break that a change of accounting standards makes.
ACCOUNTING = "accounting"


def place(period: Column) -> Column:
    """A period text's digits as a number: they sort in time among texts of one frequency; null if it is no period."""
    period = F.trim(period)
    return F.when(period.rlike(r"^(FY)?\d{4}(Q[1-4]|H[12])?$|^\d{4}-\d{2}(-\d{2}E?)?$"), F.regexp_replace(period, r"\D", "").cast("long"))


def shape(period: Column) -> Column:
    """What frequencies differ by: the text without its digits and closing mark."""
    return F.translate(F.trim(period), "0123456789E", "")


def annotated(requests: DataFrame, series: DataFrame, breaks: DataFrame) -> DataFrame:
    """One row a request (request, series_id, lo, hi period texts) whose series has anything to say.

    series: series_id, first_period, usable_from, flags (array of strings, null if none). breaks: series_id,
    break_period, kind, affects_from, affects_to, affected, invariant (null where not stated). A break is in the range
    if lo < break_period <= hi; one that isn't affects the range if its width, from affects_from to affects_to (the break
    itself if null), overlaps lo to hi. Result: usable_from, breaks (all of the series), breaks_in_range,
    breaks_affecting_range, caution (what an accounting break in the range breaks; "ratios" if that isn't stated), unchanged
    (what it leaves), notice (an accounting break only affects the range), flags. A series without breaks, whose
    usable_from is its first period or null and that has no flags, gives no row. Periods of another frequency don't count.
    """
    asked = requests.withColumns({"a": place(F.col("lo")), "b": place(F.col("hi")), "freq": shape(F.col("lo"))}).filter(F.col("a") <= F.col("b"))
    made = breaks.withColumns({"at": place(F.col("break_period")), "freq": shape(F.col("break_period"))})
    inside = point_join(made, asked.withColumn("first", F.col("a") + 1).select("request", "series_id", "freq", "first", "b"), ["series_id", "freq"], "at", "first", "b", BITS)
    what = F.when(F.col("kind") == ACCOUNTING, F.struct("at", F.coalesce("affected", F.lit("ratios")).alias("affected"), "invariant"))
    inside = inside.groupBy("request").agg(F.array_sort(F.collect_set(F.struct("at", "break_period"))).alias("inside"), F.min(what).alias("first_accounting"))
    wide = made.filter("affects_from IS NOT NULL").withColumns({"since": place(F.col("affects_from")), "until": place(F.coalesce("affects_to", "break_period"))})
    wide = wide.select("series_id", "freq", "at", "since", "until", "break_period", "kind", "affects_from", F.coalesce("affects_to", "break_period").alias("affects_to"))
    around = overlap_join(asked.select("request", "series_id", "freq", "a", "b"), wide, ["series_id", "freq"], "a", "b", "since", "until", BITS).filter(~((F.col("a") < F.col("at")) & (F.col("at") <= F.col("b"))))
    around = around.groupBy("request").agg(F.array_sort(F.collect_set(F.struct("at", "break_period", "affects_from", "affects_to"))).alias("around"), F.max(F.col("kind") == ACCOUNTING).alias("accounting"))
    all_breaks = made.groupBy("series_id").agg(F.array_sort(F.collect_set(F.struct("at", "break_period"))).alias("breaks"))
    names = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<at:bigint,break_period:string>>")), lambda x: x.break_period)
    out = requests.select("request", "series_id", "lo", "hi").join(series, "series_id").join(all_breaks, "series_id", "left").join(inside, "request", "left").join(around, "request", "left")
    out = out.filter(F.col("breaks").isNotNull() | F.col("flags").isNotNull() | (F.col("usable_from") != F.col("first_period")))
    affecting = F.transform(F.coalesce(F.col("around"), F.array().cast("array<struct<at:bigint,break_period:string,affects_from:string,affects_to:string>>")), lambda x: F.struct(x.break_period.alias("break_period"), x.affects_from.alias("affects_from"), x.affects_to.alias("affects_to")))
    caution = F.col("first_accounting.affected")
    return out.select(
        "request", "series_id", "lo", "hi", F.coalesce("usable_from", "first_period").alias("usable_from"), names("breaks").alias("breaks"), names("inside").alias("breaks_in_range"), affecting.alias("breaks_affecting_range"),
        caution.alias("caution"), F.col("first_accounting.invariant").alias("unchanged"), (F.coalesce("accounting", F.lit(False)) & caution.isNull()).alias("notice"), "flags",
    )


def panel_summary(rows: DataFrame, panel: str) -> DataFrame:
    """Per panel of annotated rows: n_noted, n_caution, n_notice, n_flagged, usable_from_max, and breaks_by_period, a map in order of period."""
    total = rows.groupBy(panel).agg(
        F.count_distinct("series_id").alias("n_noted"), F.count_if(F.col("caution").isNotNull()).alias("n_caution"), F.count_if("notice").alias("n_notice"),
        F.count_if(F.col("flags").isNotNull()).alias("n_flagged"), F.max("usable_from").alias("usable_from_max"),
    )
    each = rows.select(panel, F.explode("breaks_in_range").alias("at")).groupBy(panel, "at").agg(F.count("*").alias("n"))
    counts = each.groupBy(panel).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "n")))).alias("breaks_by_period"))
    return total.join(counts, panel, "left").withColumn("breaks_by_period", F.coalesce("breaks_by_period", F.create_map().cast("map<string,bigint>")))
