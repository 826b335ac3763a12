"""Joins of points and intervals by the nodes of a binary tree over the numbers: equal keys only, no nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends of intervals lie from 0 to 2^BITS - 1 as a rule; callers with smaller numbers name fewer bits.
BITS = 24


def cover(lo: Column, hi: Column, bits: int = BITS) -> Column:
    """The fewest nodes (level, node) whose numbers are just those from lo to hi: two a level at most; none if hi < lo.

    Node n of level k stands for the numbers from n * 2^k on, 2^k of them. From the bottom up, an end that its parent
    would reach beyond is taken, and the ends move to their parents.
    """
    # both ends are cut to the tree, so that an open interval is as good as one to its end
    first, last = F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, F.lit((1 << bits) - 1)).cast("long")

    def climb(state, level):
        left, right = (state.lo <= state.hi) & (state.lo % 2 == 1), (state.lo <= state.hi) & (state.hi % 2 == 0)
        # one node alone is taken once
        right = right & ~(left & (state.lo == state.hi))
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        taken = F.concat(F.when(left, F.array(node(state.lo))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>")), F.when(right, F.array(node(state.hi))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>")))
        lo_, hi_ = F.when(left, state.lo + 1).otherwise(state.lo), F.when(right, state.hi - 1).otherwise(state.hi)
        up = F.when(lo_ <= hi_, F.struct(F.shiftright(lo_, 1).alias("lo"), F.shiftright(hi_, 1).alias("hi"))).otherwise(F.struct(F.lit(1).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")))
        return F.struct(up["lo"].alias("lo"), up["hi"].alias("hi"), F.concat(state.nodes, taken).alias("nodes"))

    begun = F.struct(first.alias("lo"), last.alias("hi"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), begun, climb, lambda s: s.nodes)


def above(at: Column, bits: int = BITS) -> Column:
    """The nodes (level, node) over a number, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at.cast("long"), level).alias("node")))


def point_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str, bits: int = BITS) -> DataFrame:
    """Each point with each interval of its keys that holds it, both ends included: keys and both sides' other columns.

    A point stands under one node of an interval's cover or under none, so that each pair is found once, by equal keys:
    rows of one key spread over the nodes, and a wide interval costs two nodes a level and not one a number. Points
    outside the tree's numbers and null ends meet nothing.
    """
    p = points.filter(F.col(at).between(0, (1 << bits) - 1)).withColumn("_node", F.explode(above(F.col(at), bits)))
    i = intervals.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("_node", F.explode(cover(F.col(lo), F.col(hi), bits)))
    return p.join(i, [*keys, "_node"]).drop("_node")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, other_lo: str, other_hi: str, bits: int = BITS) -> DataFrame:
    """Each left interval with each right one of its keys that shares a number with it; intervals with hi < lo meet nothing.

    Two intervals overlap just if the right one begins within the left, or the left one begins within the right and after
    its first number: both are point joins, and no pair is in both.
    """
    names = [*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys)]
    left, right = left.filter(F.col(lo) <= F.col(hi)), right.filter(F.col(other_lo) <= F.col(other_hi))
    begins = point_join(right.withColumn("_at", F.greatest(other_lo, F.lit(0))), left, keys, "_at", lo, hi, bits)
    after = point_join(left.withColumn("_at", F.greatest(lo, F.lit(0))), right.withColumn("_lo", F.greatest(other_lo, F.lit(0)) + 1), keys, "_at", "_lo", other_hi, bits)
    return begins.select(*names).union(after.select(*names))


def _swept(rows: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """keys, n_pairs, common of all pairs: at each number where intervals begin or end, how many others are open."""
    ends = F.explode(F.array(F.struct(F.col(lo).cast("long").alias("at"), F.lit(1).alias("begin"), F.lit(0).alias("end")), F.struct((F.col(hi).cast("long") + 1).alias("at"), F.lit(0).alias("begin"), F.lit(1).alias("end"))))
    marks = rows.select(*keys, ends.alias("e")).groupBy(*keys, "e.at").agg(F.sum("e.begin").alias("begun"), F.sum("e.end").alias("ended"))
    w = Window.partitionBy(*keys).orderBy("at")
    marks = marks.withColumns({"open": F.sum(F.col("begun") - F.col("ended")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.lead("at").over(w)})
    two = lambda n: F.shiftright(n * (n - 1), 1)
    begun, opened = F.col("begun"), F.col("open")
    return marks.groupBy(*keys).agg(F.sum(two(begun) + begun * (opened - begun)).alias("n_pairs"), F.sum(F.when(opened > 1, two(opened) * (F.col("after") - F.col("at"))).otherwise(0)).alias("common"))


def overlap_totals(rows: DataFrame, keys: list[str], id: str, lo: str, hi: str) -> DataFrame:
    """keys, n_pairs, common: how many pairs of intervals with different ids share a number, and how many they share in all.

    The pairs are counted and not made: a sweep over the numbers where a key's intervals begin and end, which grows with
    the rows, whatever overlaps. Intervals with hi < lo meet nothing; keys without a pair are left out.
    """
    rows = rows.select(*keys, id, lo, hi).filter(F.col(lo) <= F.col(hi)).dropna()
    again = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, id))).filter("_n > 1").drop("_n")
    same = _swept(again, [*keys, id], lo, hi).select(*keys, (-F.col("n_pairs")).alias("n_pairs"), (-F.col("common")).alias("common"))
    both = _swept(rows, keys, lo, hi).union(same).groupBy(*keys).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("common").alias("common"))
    return both.filter("n_pairs > 0")
