"""Segment figures of filings: one period, a range, restatements and regroupings; and which of several figures answers a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import newest_by, restated


def kind_of(member: Column, kinds: dict[str, str], other: str = "reportable") -> Column:
    """The kind of a standard member by its name (an exact key), else a company's own: reportable."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), member), F.lit(other))


def lookup(requests: DataFrame, filings: DataFrame, segments: DataFrame) -> DataFrame:
    """company, period, doc, member, value, reason for requests (company, period), from the newest document that covers the period and has segments.

    filings has company, doc, period for each period that a document covers; segments company, doc, period, member,
    value. Without such a document the reason is period_not_in_document or not_tagged; rows without any value are
    no_segment_figures.
    """
    tagged = segments.select("company", "doc").distinct().withColumn("tagged", F.lit(True))
    docs = filings.join(requests, ["company", "period"], "left_semi").join(tagged, ["company", "doc"], "left")
    best = docs.groupBy("company", "period").agg(F.max(F.when(F.col("tagged"), F.col("doc"))).alias("doc"))
    figures = requests.join(best.withColumn("covered", F.lit(True)), ["company", "period"], "left").join(segments, ["company", "period", "doc"], "left")
    per = figures.groupBy("company", "period").agg(F.count("value").alias("n"))
    reason = F.when(F.col("covered").isNull(), "period_not_in_document").when(F.col("doc").isNull(), "not_tagged").when(F.col("n") == 0, "no_segment_figures")
    out = figures.join(per, ["company", "period"]).withColumn("reason", reason)
    full = out.filter("reason IS NULL AND value IS NOT NULL").select("company", "period", "doc", "member", "value", "reason")
    none = out.filter("reason IS NOT NULL").select("company", "period", "doc", F.lit(None).cast("string").alias("member"), F.lit(None).cast(segments.schema["value"].dataType).alias("value"), "reason").distinct()
    return full.unionByName(none)


def range_of(segments: DataFrame) -> DataFrame:
    """company, member, period, doc, value: each period's figure from the newest document that has it."""
    return newest_by(segments.filter("value IS NOT NULL"), ["company", "member", "period"], ["value"])


def restated_segments(segments: DataFrame) -> DataFrame:
    """Figures that another document gives differently, however little: what is printed is compared, not a unit."""
    return restated(segments.filter("value IS NOT NULL"), "value", F.lit(0), ("company", "member", "period"))


def by_standard(rows: DataFrame, keys: list[str], declared: DataFrame) -> DataFrame:
    """keys, status, standard, value, others: of figures under several standards the one that the company declares.

    rows has keys, standard, value, one row a standard; declared company, standard. One standard alone is found; without
    a declared one among several the answer is ambiguous, and others lists them.
    """
    d = declared.select("company", F.col("standard").alias("declared"))
    g = rows.join(d, "company", "left").groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("standard") == F.col("declared"), F.struct("standard", "value"))).alias("own"), F.min(F.struct("standard", "value")).alias("one"), F.sort_array(F.collect_set("standard")).alias("all"))
    pick = F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("own"))
    out = g.withColumn("pick", pick)
    return out.select(*keys, F.when(F.col("pick").isNull(), "ambiguous").otherwise("found").alias("status"), F.col("pick.standard").alias("standard"), F.col("pick.value").alias("value"), F.array_join(F.filter("all", lambda x: ~x.eqNullSafe(F.col("pick.standard"))), ",").alias("others"))


def siblings(family: list[str], item: str) -> Column:
    """The other items of the family that a row has, if it lacks the item; else null."""
    have = F.filter(F.array(*(F.when(F.col(i).isNotNull(), F.lit(i)) for i in family if i != item)), lambda x: x.isNotNull())
    return F.when(F.col(item).isNull(), have)


def companion(item: str, pairs: dict[str, str]) -> Column:
    """The value of the item that always goes with this one (a year and its month, say), or null."""
    return F.col(pairs[item]) if item in pairs else F.lit(None)


def top_line(items: list[str], offsets: int) -> tuple[Column, Column]:
    """(item, reason): the first item that a row has at every offset (columns item, item_1, ...), so that it is one item throughout."""
    whole = lambda i: F.forall(F.array(*(F.col(f"{i}_{n}" if n else i).isNotNull() for n in range(offsets + 1))), lambda x: x)
    item = F.coalesce(*(F.when(whole(i), F.lit(i)) for i in items))
    some = F.exists(F.array(*(F.col(i).isNotNull() for i in items)), lambda x: x)
    return item, F.when(item.isNull(), F.when(some, "item_changes").otherwise("input_not_disclosed"))


def bottom_line(basis: Column, owners: Column, net: Column) -> Column:
    """Owners' profit where the basis is consolidated, else the net income."""
    return F.when(basis == "consolidated", owners).otherwise(net)
