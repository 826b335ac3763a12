"""Data quality: identities, sums over a hierarchy, reconciliation and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity_gaps(rows: DataFrame, left: Column, right: Column, tolerance: float | Column) -> DataFrame:
    """Rows whose two sides differ by more than the tolerance."""
    return rows.withColumn("gap", left - right).filter(F.abs("gap") > tolerance)


def sum_check(children: DataFrame, parents: DataFrame, keys: list[str], period: str, relative: float = 1e-6) -> DataFrame:
    """Per key and period the sum of the children against the parent, with ok and consistent_from.

    A child without a value counts as 0 outside the years that it spans, and fails the period within. consistent_from is
    the earliest period from which on all hold.
    """
    spans = children.groupBy(*keys, "child").agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    total = children.groupBy(*keys, period).agg(F.sum("value").alias("children"), F.count("*").alias("n"))
    due = parents.join(spans, keys).filter(F.col(period).between(F.col("lo"), F.col("hi"))).groupBy(*keys, period).agg(F.count("*").alias("due"))
    out = parents.join(total, [*keys, period], "left").join(due, [*keys, period], "left").na.fill(0, ["n", "due"])
    gap = F.abs(F.coalesce("children", F.lit(0)) - F.col("value"))
    out = out.withColumn("ok", (F.col("n") >= F.col("due")) & (gap <= F.greatest(F.lit(1.0), relative * F.abs("value"))))
    after = Window.partitionBy(*keys).orderBy(period).rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("_all", F.min(F.col("ok").cast("int")).over(after) == 1)
    return out.withColumn("consistent_from", F.min(F.when(F.col("_all"), F.col(period))).over(Window.partitionBy(*keys))).drop("_all", "n", "due")


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], factor: float, tolerance: float) -> DataFrame:
    """Keys of both sources with a - factor * b beyond the tolerance, or in one source only."""
    both = a.withColumnRenamed("value", "a_value").join(b.withColumnRenamed("value", "b_value"), keys, "full")
    status = F.when(F.col("a_value").isNull(), "only_b").when(F.col("b_value").isNull(), "only_a").when(F.abs(F.col("a_value") - factor * F.col("b_value")) <= tolerance, "equal").otherwise("different")
    return both.withColumn("status", status)


def violations(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that a row breaks."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)), lambda x: x.isNotNull())


def audit(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """violation, n over all rows."""
    return rows.select(F.explode(violations(rules)).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def carried(rows: DataFrame, keys: list[str], order: str, value: str) -> Column:
    """The last value that isn't null, in order."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def regrouped(rows: DataFrame, keys: list[str], period: str, member: str) -> DataFrame:
    """Members that come and go between a key's consecutive periods."""
    sets = rows.groupBy(*keys, period).agg(F.array_sort(F.collect_set(member)).alias("now"))
    w = Window.partitionBy(*keys).orderBy(period)
    return sets.withColumn("before", F.lag("now").over(w)).filter("before IS NOT NULL").select(*keys, period, F.array_sort(F.array_except("now", "before")).alias("added"), F.array_sort(F.array_except("before", "now")).alias("removed"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many different ids are in both, in a alone and in b alone, and whether the sets are equal. Null is no id."""
    sides = a.select(F.col(key).alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(key), F.lit(0), F.lit(1)))
    ids = sides.filter("id IS NOT NULL").groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = ids.agg(F.count_if(F.col("a") == F.col("b")).alias("both"), F.count_if(F.col("a") > F.col("b")).alias("only_a"), F.count_if(F.col("a") < F.col("b")).alias("only_b"))
    return n.withColumn("equal", F.expr("only_a + only_b = 0"))
