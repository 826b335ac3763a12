"""Guarded writers: a version is written beside the others, checked as it stands there, and only then becomes current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.checks import audit
from quillstone.sources.sinks import current, fingerprint, point_at

#: Most values of all factored columns together: beyond it they don't repeat enough for a table of their own.
DICTIONARY = 1_000_000
#: Fixed value: what closes a note before an alias is added.
STOP = "。"


class Refused(ValueError):
    """A write that did not happen: reason and what was counted; readers go on with the version before."""

    def __init__(self, reason: str, counts: dict):
        super().__init__(f"{reason}: {counts}")
        self.reason, self.counts = reason, counts


def changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """One row: both, only_old, only_new, repeated (ids that stand twice on a side), texts and fields (ids whose text, or another column, differs).

    Rows are compared by digests of 256 bits, so that no text is shuffled; a column that one side lacks differs where the
    other has a value. Null is an id like any other.
    """
    others = sorted(({*old.columns} | {*new.columns}) - {key, text})

    def side(rows: DataFrame, old_side: bool) -> DataFrame:
        fields = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast((new if old_side else old).schema[c].dataType) for c in others]
        digest = lambda c: F.sha2(F.coalesce(c, F.lit("\0")), 256)
        return rows.select(F.col(key).alias("id"), F.lit(old_side).alias("old"), digest(F.col(text)).alias("t"), digest(F.to_json(F.struct(*(f.alias(f"c{i}") for i, f in enumerate(fields))))).alias("f"))

    at = lambda c, which: F.max(F.when(F.col("old") == which, F.col(c)))
    ids = side(old, True).unionByName(side(new, False)).groupBy("id").agg(F.count_if("old").alias("o"), F.count_if(~F.col("old")).alias("n"), at("t", True).alias("t0"), at("t", False).alias("t1"), at("f", True).alias("f0"), at("f", False).alias("f1"))
    in_both = F.expr("o > 0 AND n > 0")
    return ids.agg(
        F.count_if(in_both).alias("both"), F.count_if(F.expr("n = 0")).alias("only_old"), F.count_if(F.expr("o = 0")).alias("only_new"), F.count_if(F.expr("o > 1 OR n > 1")).alias("repeated"),
        F.count_if(in_both & (F.col("t0") != F.col("t1"))).alias("texts"), F.count_if(in_both & (F.col("f0") != F.col("f1"))).alias("fields"),
    )


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _valid(rows: DataFrame, rules: list[tuple[str, Column]]) -> None:
    broken = {r.violation: r.n for r in audit(rows, rules).collect()} if rules else {}
    if broken:
        raise Refused("invalid", broken)


def overwrite_metadata(rows: DataFrame, root: str, version: str, key: str, text: str, rules: list[tuple[str, Column]] = ()) -> dict:
    """Make rows the current version of root if all keep the rules and ids and texts are those of the version before; returns the counts.

    Else Refused: invalid, repeated_ids, ids_differ (units came or went: index them anew) or texts_differ (their vectors
    are of other texts). What is checked is what was written; nothing is current before the last check.
    """
    spark = rows.sparkSession
    path = f"{root}/versions/{version}"
    new = _written(rows, path)
    _valid(new, list(rules))
    n = changes(current(spark, root), new, key, text).first().asDict()
    for reason, bad in (("repeated_ids", n["repeated"]), ("ids_differ", n["only_old"] + n["only_new"]), ("texts_differ", n["texts"])):
        if bad:
            raise Refused(reason, n)
    point_at(spark, root, path)
    return n


def with_aliases(rows: DataFrame, aliases: DataFrame, key: str, notes: str) -> DataFrame:
    """notes with the alias of each key added, as a sentence of its own. Refused: unused_aliases or repeated_aliases, with some of them."""
    a = aliases.select(F.col(key).alias("_key"), F.col("alias").alias("_alias"))
    for reason, bad in (("repeated_aliases", a.groupBy("_key").count().filter("count > 1")), ("unused_aliases", a.join(rows.select(F.col(key).alias("_key")), "_key", "left_anti"))):
        some = [r["_key"] for r in bad.select("_key").orderBy("_key").limit(20).collect()]
        if some:
            raise Refused(reason, {"keys": some})
    note = F.coalesce(F.col(notes), F.lit(""))
    added = F.concat(note, F.when((note == "") | note.endswith(STOP), "").otherwise(STOP), "_alias")
    out = rows.join(a, F.col(key) == F.col("_key"), "left").withColumn(notes, F.when(F.col("_alias").isNull(), F.col(notes)).otherwise(added))
    return out.drop("_key", "_alias")


def factored(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with <column>@ numbers in the place of the text columns' values, and the table (column, number, value).

    Numbers follow the values' order. A null or empty value stays in the row, its number null.
    """
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))).alias("e")).select("e.*").filter("value <> ''").distinct()
    n = each.count()
    if n > DICTIONARY:
        raise Refused("too_many_values", {"values": n})
    # the values alone are numbered, at most DICTIONARY of them
    shared = each.withColumn("number", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)
    for c in columns:
        codes = F.broadcast(shared.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("number").alias(f"{c}@")))
        rows = rows.join(codes, c, "left").withColumn(c, F.when(F.col(f"{c}@").isNull(), F.col(c)))
    return rows, shared.select("column", "number", "value")


def restored(rows: DataFrame, shared: DataFrame, columns: list[str]) -> DataFrame:
    """The rows before factored; a number that the table lacks is an error of the pair."""
    for c in columns:
        codes = F.broadcast(shared.filter(F.col("column") == c).select(F.col("number").alias(f"{c}@"), F.col("value").alias("_value")))
        lost = F.raise_error(F.concat(F.lit(f"no value for {c} "), F.col(f"{c}@").cast("string"))).cast("string")
        rows = rows.join(codes, f"{c}@", "left").withColumn(c, F.when(F.col(f"{c}@").isNull(), F.col(c)).when(F.col("_value").isNull(), lost).otherwise(F.col("_value"))).drop("_value", f"{c}@")
    return rows


def write_registry(rows: DataFrame, root: str, version: str, columns: list[str], rules: list[tuple[str, Column]] = ()) -> str:
    """A registry's version: checked rows with numbers, the shared table, and the table's fingerprint, as they belong together."""
    spark = rows.sparkSession
    path = f"{root}/versions/{version}"
    _valid(rows, list(rules))
    coded, shared = factored(rows, columns)
    _written(coded, f"{path}/rows")
    fingerprint(_written(shared, f"{path}/shared")).coalesce(1).write.json(f"{path}/fingerprint")
    point_at(spark, root, path)
    return path


def read_registry(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """The current version's rows; Refused (pair_differs) if the shared table is not the one that they were written with."""
    path = spark.read.json(f"{root}/current").first()["path"]
    shared = spark.read.parquet(f"{path}/shared")
    want, have = (r.asDict() for r in (spark.read.json(f"{path}/fingerprint").first(), fingerprint(shared).first()))
    if want != have:
        raise Refused("pair_differs", {"written": want, "found": have})
    return restored(spark.read.parquet(f"{path}/rows"), shared, columns)
