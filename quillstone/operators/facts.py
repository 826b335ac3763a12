"""Bitemporal facts: (company, doc, basis, period) rows with a column for each item; later documents restate periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(facts: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """Of each key the rows of the newest document."""
    newest = F.max(doc).over(Window.partitionBy(*keys))
    return facts.withColumn("_newest", newest).filter(F.col(doc) == F.col("_newest")).drop("_newest")


def newest_by(facts: DataFrame, keys: list[str], values: list[str], doc: str = "doc") -> DataFrame:
    """One row a key with the values of its newest document: an aggregate, so that rows are combined before the shuffle."""
    return facts.groupBy(*keys).agg(F.max_by(F.struct(doc, *values), doc).alias("s")).select(*keys, "s.*")


def as_of(facts: DataFrame, when: int, keys: list[str], values: list[str]) -> DataFrame:
    """What was known by then: documents after it don't count."""
    return newest_by(facts.filter(F.col("doc") <= when), keys, values)


def in_window(facts: DataFrame, first: int, last: int) -> DataFrame:
    """The newest document of each (company, basis) whose own period lies in the window, with that period's row."""
    return latest(facts.filter((F.col("doc") == F.col("period")) & F.col("period").between(first, last)), ["company", "basis"])


def restated(facts: DataFrame, item: str, unit: Column, keys: tuple[str, ...] = ("company", "basis", "period")) -> DataFrame:
    """Keys whose value in another document differs from the newest by more than the greater unit of both."""
    base = facts.select(*keys, "doc", F.col(item).alias("value"), unit.alias("unit"))
    now = newest_by(base, list(keys), ["value", "unit"]).withColumnsRenamed({"doc": "newest_doc", "value": "newest_value", "unit": "newest_unit"})
    off = F.abs(F.col("value") - F.col("newest_value")) > F.greatest("unit", "newest_unit")
    return base.join(now, list(keys)).filter((F.col("doc") != F.col("newest_doc")) & off)


def with_offsets(facts: DataFrame, items: list[str], most: int) -> DataFrame:
    """Columns item_1 .. item_most and period_1 ..: the earlier periods of the same document and basis."""
    w = Window.partitionBy("company", "doc", "basis").orderBy(F.col("period").desc())
    return facts.withColumns({f"{x}_{n}": F.lead(x, n).over(w) for x in [*items, "period"] for n in range(1, most + 1)})


def first_computable(rows: DataFrame, keys: list[str], value: str, reason: str, doc: str = "doc") -> DataFrame:
    """Of each key the newest document that has a value; if none has, the newest one's reason.

    A period that isn't in the newest document gives way to a later reason of another kind.
    """
    rank = F.struct(F.col(value).isNotNull().alias("v"), (F.col(reason) != "period_not_in_document").alias("r"), F.col(doc).alias("d"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(doc, value, reason), rank).alias("s")).select(*keys, "s.*")


def default_basis(facts: DataFrame, keys: list[str]) -> DataFrame:
    """consolidated where the key has such facts, else non_consolidated."""
    return facts.groupBy(*keys).agg(F.bool_or(F.col("basis") == "consolidated").alias("c")).select(*keys, F.when(F.col("c"), "consolidated").otherwise("non_consolidated").alias("basis"))


def resolve(queries: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """query, status, n, candidates: code, else securities code, else exact name, else part of a name; never a guess.

    queries has query, names has code, sec_code, key (lower case, one row a known name). The exact tiers are equi-joins;
    only queries that they leave are looked for inside names.
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).distinct()
    tiers = [names.select(F.lower("code").alias("q"), "code", F.lit(1).alias("tier")), names.select(F.col("sec_code").alias("q"), "code", F.lit(2).alias("tier")), names.select(F.col("key").alias("q"), "code", F.lit(3).alias("tier"))]
    exact = q.join(reduce(DataFrame.union, tiers), "q").select("query", "code", "tier")
    rest = q.join(exact, "query", "left_anti")
    inside = rest.join(names.select("key", "code"), F.col("key").contains(F.col("q")) & (F.length("q") > 0)).select("query", "code", F.lit(4).alias("tier"))
    found = exact.union(inside).distinct()
    tier = found.groupBy("query").agg(F.min("tier").alias("tier"))
    fits = found.join(tier, ["query", "tier"])
    # only the first codes of a query are gathered, however many there are
    some = fits.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("code"))).filter(F.col("_n") <= limit)
    best = fits.groupBy("query").agg(F.count("*").alias("n")).join(some.groupBy("query").agg(F.sort_array(F.collect_list("code")).alias("codes")), "query")
    out = queries.select("query").distinct().join(best, "query", "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select("query", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.array_join(F.slice(F.coalesce("codes", F.array().cast("array<string>")), 1, limit), ",").alias("candidates"))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds."""
    return F.coalesce(*(F.when(c, F.lit(r)) for c, r in checks))


def priority_pick(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first non-null value by the order columns."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))
