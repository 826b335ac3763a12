"""Trends: one value a year and company, aggregated over a window, or a reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregates that need two years at least.
NEED_TWO = ("cagr", "change", "ratio", "streak_up", "streak_down")


def yearly(rows: DataFrame) -> DataFrame:
    """company, period, value with regular: the next older period is a year before."""
    w = Window.partitionBy("company").orderBy("period")
    return rows.withColumn("regular", (F.col("period") - F.lag("period").over(w) == 1) | F.lag("period").over(w).isNull())


def aggregated(rows: DataFrame, least: float | Column | None = None, most: float | Column | None = None, keys: tuple[str, ...] = ("company",)) -> DataFrame:
    """All aggregates of the keys, period, value in one shuffle, with the reasons of those that have none.

    The streaks count strict steps back from the newest year. Reasons come in order: irregular_period,
    insufficient_history, nonpositive_start, negative_end.
    """
    w = Window.partitionBy(*keys).orderBy("period")
    step = rows.withColumns({"before": F.lag("value").over(w), "year_before": F.lag("period").over(w)})
    up, down = F.coalesce(F.col("value") > F.col("before"), F.lit(False)), F.coalesce(F.col("value") < F.col("before"), F.lit(False))
    step = step.withColumns({"not_up": F.when(~up, F.col("period")), "not_down": F.when(~down, F.col("period")), "gap": F.col("period") - F.col("year_before") != 1})
    inside = F.lit(True)
    inside = inside & (F.col("value") >= least) if least is not None else inside
    inside = inside & (F.col("value") <= most) if most is not None else inside
    total = step.groupBy(*keys).agg(
        F.count("*").alias("years"), F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), F.min("period").alias("from_period"), F.max("period").alias("to_period"),
        F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(inside).alias("years_meeting"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gaps"),
        F.max("not_up").alias("last_not_up"), F.max("not_down").alias("last_not_down"),
    )
    return total.withColumns({
        "streak_up": F.col("to_period") - F.col("last_not_up"), "streak_down": F.col("to_period") - F.col("last_not_down"),
        "why": F.when(F.col("gaps"), "irregular_period").when(F.col("years") < 2, "insufficient_history"),
        "why_ratio": F.when(F.col("gaps"), "irregular_period").when(F.col("years") < 2, "insufficient_history").when(F.col("first") <= 0, "nonpositive_start"),
        "why_cagr": F.when(F.col("gaps"), "irregular_period").when(F.col("years") < 2, "insufficient_history").when(F.col("first") <= 0, "nonpositive_start").when(F.col("last") < 0, "negative_end"),
    }).withColumns({
        "change": F.when(F.col("why").isNull(), F.col("last") - F.col("first")),
        "ratio": F.when(F.col("why_ratio").isNull(), F.try_divide(F.col("last").cast("double"), F.col("first").cast("double"))),
        "cagr": F.when(F.col("why_cagr").isNull(), F.pow(F.try_divide(F.col("last").cast("double"), F.col("first").cast("double")), F.lit(1.0) / F.greatest(F.col("years") - 1, F.lit(1))) - 1),
    })


def compact(rows: DataFrame) -> DataFrame:
    """company with its periods and values as arrays, the newest first; a company has few years."""
    return rows.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("period", "value")), asc=False).alias("s")).select("company", F.col("s.period").alias("periods"), F.col("s.value").alias("values"))


def split_suspects(facts: DataFrame, items: list[str], spread: float = 1.02, distance: float = 0.05) -> DataFrame:
    """Consecutive documents in which all items changed by one factor: company, old and new doc, the factor's range."""
    old = facts.select("company", "period", F.col("doc").alias("old_doc"), *(F.col(x).cast("double").alias(f"old_{x}") for x in items))
    both = facts.withColumn("old_doc", F.col("doc") - 1).join(old, ["company", "period", "old_doc"])
    factors = F.filter(F.array(*(F.try_divide(F.col(x).cast("double"), F.col(f"old_{x}")) for x in items)), lambda r: r.isNotNull())
    ratio = both.select("company", "old_doc", "doc", F.explode(factors).alias("r")).groupBy("company", "old_doc", "doc").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"))
    return ratio.withColumn("suspect", (F.try_divide(F.col("hi"), F.col("lo")) < spread) & (F.abs(F.col("lo") - 1) > distance))


def jumps(rows: DataFrame, values: list[str], factor: float = 1.45) -> DataFrame:
    """Years in which all values moved by the factor at least, in one direction: company, period, direction."""
    w = Window.partitionBy("company").orderBy("period")
    r = {f"r_{v}": F.try_divide(F.col(v).cast("double"), F.lag(v).over(w).cast("double")) for v in values}
    out = rows.withColumns(r)
    up, down = F.lit(True), F.lit(True)
    for v in values:
        up &= F.coalesce(F.col(f"r_{v}") >= factor, F.lit(False))
        down &= F.coalesce(F.col(f"r_{v}") <= 1 / factor, F.lit(False))
    return out.withColumn("direction", F.when(up, "up").when(down, "down")).filter("direction IS NOT NULL").select("company", "period", "direction")
