"""Keeping tables of documents current: upserts, new items, duplicates and units of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import bounded_parts


def upsert_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_sticky(old: DataFrame, new: DataFrame, key: str, sticky: list[str]) -> DataFrame:
    """new over old by key; sticky columns keep what old has where that isn't empty."""
    o, n = old.alias("o"), new.alias("n")
    out = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    pick = lambda c: F.when(F.col(f"n.{key}").isNull(), F.col(f"o.{c}")).when((F.col(f"o.{c}").cast("string") != "") & F.lit(c in sticky), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return out.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(pick(c).alias(c) for c in old.columns if c != key))


def not_yet(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key).distinct(), key, "left_anti")


def not_yet_by_prefix(new: DataFrame, old: DataFrame, key: str, mark: str = "_") -> DataFrame:
    """New rows of which old has neither the key nor one that begins with it and the mark: an equi-join on old's prefixes."""
    parts = F.split(F.col(key), mark)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), mark))
    return new.join(old.select(F.explode(prefixes).alias(key)).distinct(), key, "left_anti")


def first_copies(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Of rows with equal content the first in order: combined before the shuffle, and the content itself isn't shuffled."""
    return rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.min(F.struct(*order)).alias("f"), F.count("*").alias("copies")).select("digest", "f.*", "copies")


def merged_units(units: DataFrame, keys: list[str], order: str, speaker: str, limit: int) -> DataFrame:
    """Neighbouring pieces of one speaker joined up to the limit of characters: keys, island, speaker, part, text."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce(F.col(speaker) != F.lag(speaker).over(w), F.lit(True)).cast("int")
    island = units.withColumn("_c", change).withColumn("island", F.sum("_c").over(w))
    joined = island.groupBy(*keys, "island", speaker).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]).alias("pieces"))
    return joined.select(*keys, "island", speaker, F.posexplode(bounded_parts(F.col("pieces"), limit)).alias("part", "text"))


def record_kind(units: DataFrame, keys: list[str]) -> DataFrame:
    """verbatim if any unit is; else named or anonymous by majority."""
    return units.groupBy(*keys).agg(F.when(F.bool_or(F.col("mode") == "verbatim"), "verbatim").when(F.count_if(F.col("mode") == "named") * 2 >= F.count("*"), "named").otherwise("anonymous").alias("kind"))


def pending_since(state: DataFrame, changed: DataFrame, today: str) -> DataFrame:
    """key, since: the first day that a change was seen, kept until the key no longer differs."""
    return changed.join(state, "key", "left").select("key", F.coalesce("since", F.lit(today)).alias("since"))
