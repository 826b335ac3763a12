"""Screens: conditions on compiled expressions over each company's newest filing, with every exclusion counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.periods import months_between

from .expr import NUMBER, Vocabulary, compiled, parse, terms
from .facts import latest, with_offsets


@dataclass(frozen=True)
class Condition:
    name: str
    expr: str
    least: float | None = None
    most: float | None = None


def evaluated(facts: DataFrame, conditions: list[Condition], words: Vocabulary) -> DataFrame:
    """company, basis, period and for each condition c_<name>, why_<name>, at the newest period of the newest document.

    Every condition is evaluated for every company. Offsets are read inside one document, and only if each step back is
    a year: else irregular_period, or period_not_in_document beyond the last. A missing item is input_not_disclosed.
    """
    trees = {c.name: parse(c.expr, words) for c in conditions}
    used = sorted({t for tree in trees.values() for t in terms(tree)})
    items = sorted({n for n, _ in used})
    most = max((o for _, o in used), default=0)
    wide = with_offsets(latest(facts, ["company", "basis"]), items, most)
    top = latest(wide, ["company", "basis"], "period")

    def item(name: str, offset: int):
        value = F.col(f"{name}_{offset}" if offset else name)
        reason = F.when(value.isNull(), F.lit("input_not_disclosed"))
        for k in range(offset, 0, -1):
            at = F.col(f"period_{k}")
            reason = F.when(at.isNull(), F.lit("period_not_in_document")).when(at != F.col("period") - k, F.lit("irregular_period")).otherwise(reason)
        return value.cast(NUMBER), reason

    out = top.select("company", "basis", "period", *(c.alias(f"{p}_{n}") for n, tree in trees.items() for p, c in zip(("c", "why"), compiled(tree, item))))
    return out


#: Fixed value: a newest period that ended more months ago is stale.
STALE_MONTHS = 18


def stale(rows: DataFrame, as_of: str, months: int = STALE_MONTHS) -> DataFrame:
    """With why_stale: the newest period, a year, ended more than so many months before the month as_of (YYYY-MM)."""
    ended = F.concat(F.col("period").cast("string"), F.lit("-12"))
    return rows.withColumn("why_stale", F.when(months_between(ended, F.lit(as_of)) > months, "stale_period"))


def passes(conditions: list[Condition]):
    out = F.lit(True)
    for c in conditions:
        value = F.col(f"c_{c.name}")
        out &= value.isNotNull()
        out = out & (value >= c.least) if c.least is not None else out
        out = out & (value <= c.most) if c.most is not None else out
    return out


def ranked(rows: DataFrame, conditions: list[Condition], order_by: str, descending: bool = True, limit: int | None = None) -> DataFrame:
    """Rows that meet all conditions, by value and then company (ascending either way)."""
    key = F.col(f"c_{order_by}")
    out = rows.filter(passes(conditions)).orderBy(key.desc() if descending else key.asc(), F.col("company").asc())
    return out.limit(limit) if limit else out


def exclusions(rows: DataFrame, conditions: list[Condition], examples: int = 5) -> DataFrame:
    """condition, reason, n, examples: rows that could not be judged, by each condition's reason."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c.name).alias("condition"), F.col(f"why_{c.name}").alias("reason")) for c in conditions)))
    each = rows.select("company", pairs.alias("p")).select("company", "p.*").filter("reason IS NOT NULL")
    # only the first companies of a reason are gathered, however many there are
    first = F.row_number().over(Window.partitionBy("condition", "reason").orderBy("company"))
    some = each.distinct().withColumn("_n", first).filter(F.col("_n") <= examples).groupBy("condition", "reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list("company")), lambda c: c.cast("string")), ",").alias("examples"))
    return each.groupBy("condition", "reason").agg(F.count("*").alias("n")).join(some, ["condition", "reason"])


def unavailable(rows: DataFrame, items: list[str]) -> DataFrame:
    """item, n: how many rows lack each item, the most frequent first."""
    gone = F.explode(F.filter(F.array(*(F.when(F.col(i).isNull(), F.lit(i)) for i in items)), lambda x: x.isNotNull()))
    return rows.select(gone.alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item")
