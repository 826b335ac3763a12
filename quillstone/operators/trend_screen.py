"""Screens over series of years: conditions in order, one basis and one standard along a series, and who falls out where.

Facts have company, doc (in order of submission), declared (the document's standard), standard (the row's), basis, period
(months: year * 12 + month) and the items; a document may have a row for each standard of a period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import NUMBER, Vocabulary, compiled, parse, terms
from .facts import with_offsets
from .trend import NEED_TWO, aggregated

# Length of the default window in years, months that filings lag behind, growth of share counts that breaks a series.
YEARS, LAG, JUMP = 13, 4, 1.45
AGGREGATES = ("cagr", "change", "ratio", "mean", "min", "max", "streak_up", "streak_down", "years_meeting")
MOST_CONDITIONS = 5
#: The item that stands for the first disclosed of the top lines, the same one in all years of a series.
TOP = "top_line"


@dataclass(frozen=True)
class TrendCondition:
    aggregate: str
    expr: str
    least: float | None = None
    most: float | None = None
    year_least: float | None = None
    year_most: float | None = None

    @property
    def name(self) -> str:
        return f"{self.aggregate}:{self.expr}"

    def checked(self) -> TrendCondition:
        if self.aggregate not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.aggregate}")
        if self.aggregate == "years_meeting" and self.year_least is None and self.year_most is None:
            raise ValueError("years_meeting needs year_least or year_most")
        return self


@dataclass(frozen=True)
class Shares:
    """Items a share, and what tells the number of shares: pairs of a total and an item a share."""

    per_share: frozenset[str]
    bases: tuple[tuple[str, str], ...]
    profit: str
    issued: str


def default_window(as_of: int, years: int = YEARS) -> tuple[int, int]:
    """First and last period, in months, for a month as_of: the same years for every company, but for filings still due."""
    return as_of - LAG - 12 * years + 1, as_of - LAG


def frame(facts: DataFrame, first: int | None, last: int | None, basis: str | None = None) -> DataFrame:
    """A row a company: standard, basis, newest (last period), from which years, and why a series can't be (reason, at).

    The newest document whose own period is not after last sets the standard and, unless given, the basis: consolidated
    if it has such facts of that period. Reasons in order: no_period_in_window; insufficient_history (a year or more is
    missing at an end that was asked for); irregular_period (a year does not follow the period before it, in or out of the
    window, by 12 months); no_consolidated_statements or input_not_disclosed (no year has the basis); basis_changed.
    """
    docs = facts.groupBy("company", "doc").agg(F.max("period").alias("own"), F.max(F.when(F.col("basis") == "consolidated", F.col("period"))).alias("whole"), F.min("declared").alias("declared"))
    usable = F.lit(True) if last is None else F.col("own") <= last
    head = docs.groupBy("company").agg(F.max_by(F.when(usable, F.struct("own", "whole", "declared")), F.when(usable, F.col("doc"))).alias("s"))
    chosen = F.lit(basis) if basis else F.when(F.col("s.whole") == F.col("s.own"), "consolidated").otherwise("non_consolidated")
    head = head.select("company", F.col("s.own").alias("own"), F.col("s.declared").alias("standard"), F.when(F.col("s.own").isNotNull(), chosen).alias("basis"))
    has = lambda b: F.bool_or(F.col("basis") == b)
    periods = facts.groupBy("company", "period").agg(has("consolidated").alias("c"), has("non_consolidated").alias("n"))
    periods = periods.withColumn("before", F.lag("period").over(Window.partitionBy("company").orderBy("period"))).join(head, "company", "right")
    inside = F.col("period") <= (F.lit(last) if last is not None else F.col("own"))
    inside = inside & (F.col("period") >= first) if first is not None else inside
    with_basis = F.when(F.col("basis") == "consolidated", F.col("c")).otherwise(F.col("n"))
    at = lambda c: F.when(inside, c)
    years = periods.groupBy("company", "own", "standard", "basis").agg(
        F.min(at(F.col("period"))).alias("oldest"), F.max(at(F.col("period"))).alias("newest"), F.count(at(F.lit(1))).alias("years"), F.count_if(inside & with_basis).alias("have"),
        F.min(at(F.when(F.col("period") - F.col("before") != 12, F.col("period")))).alias("gap"), F.min(at(F.when(~with_basis, F.col("period")))).alias("without"),
    )
    late = F.col("oldest") - first >= 12 if first is not None else F.lit(False)
    early = last - F.col("newest") >= 12 if last is not None else F.lit(False)
    none = F.when(F.col("basis") == "consolidated", "no_consolidated_statements").otherwise("input_not_disclosed")
    reason = F.coalesce(
        F.when(F.col("own").isNull() | (F.col("years") == 0), "no_period_in_window"), F.when(late | early, "insufficient_history"), F.when(F.col("gap").isNotNull(), "irregular_period"),
        F.when(F.col("have") == 0, none), F.when(F.col("have") < F.col("years"), "basis_changed"),
    )
    where = F.when(reason == "irregular_period", F.col("gap")).when(reason == "basis_changed", F.col("without")).when(reason == "insufficient_history", F.when(late, F.col("oldest")).otherwise(F.col("newest")))
    return years.select("company", "standard", "basis", "oldest", "newest", reason.alias("reason"), where.alias("at"))


def _term(name: str, offset: int, tops: tuple[str, ...]) -> tuple[Column, Column]:
    """Value and reason of a term in a row with offsets: the document must have the period, a year a step before."""
    end = f"_{offset}" if offset else ""
    if name == TOP:
        candidates = lambda other="": [F.col(f"{other}{t}{end}") for t in tops]
        value = F.get(F.array(*candidates()), F.col("top"))
        # another line of the series' standard: the line changed; lines of other standards alone: the standard did
        lost = F.when(F.coalesce(*candidates()).isNotNull(), "top_line_changed").when(F.exists(F.array(*candidates("other_")), lambda o: o), "standard_changed").otherwise("input_not_disclosed")
    else:
        value = F.col(f"{name}{end}")
        lost = F.when(F.col(f"other_{name}{end}"), "standard_changed").otherwise("input_not_disclosed")
    reason = F.when(value.isNull(), lost)
    for k in range(offset, 0, -1):
        at = F.col(f"period_{k}")
        reason = F.when(at.isNull(), "period_not_in_document").when(at != F.col("period") - 12 * k, "irregular_period").otherwise(reason)
    return value.cast(NUMBER), reason


def years(facts: DataFrame, frames: DataFrame, exprs: dict[str, str], words: Vocabulary, tops: tuple[str, ...] = (), shares: Shares | None = None) -> DataFrame:
    """company, name, period, doc, value, reason, counts: each year's value of each expression, from the newest document that has all its inputs.

    Only companies whose frame has no reason; facts of the frame's basis and standard. counts are the numbers of shares
    that the source document's own figures give for the year, null where a total or an item a share is 0 or missing.
    """
    trees = {name: parse(text, words) for name, text in exprs.items()}
    used = sorted({t for tree in trees.values() for t in terms(tree)})
    bases = shares.bases if shares else ()
    items = sorted({n for n, _ in used if n != TOP} | (set(tops) if any(n == TOP for n, _ in used) else set()) | {i for b in bases for i in b})
    most = max((o for _, o in used), default=0)
    good = frames.filter("reason IS NULL").select("company", "basis", F.col("standard").alias("_standard"), "oldest", "newest")
    mine = F.col("standard") == F.col("_standard")
    # rows of other standards give only the fact that something is there
    rows = facts.join(good, ["company", "basis"]).groupBy("company", "doc", "basis", "period", "oldest", "newest").agg(
        *(F.max(F.when(mine, F.col(i))).alias(i) for i in items), *(F.coalesce(F.bool_or(~mine & F.col(i).isNotNull()), F.lit(False)).alias(f"other_{i}") for i in items))
    wide = with_offsets(rows, [*items, *(f"other_{i}" for i in items)], most).filter(F.col("period").between(F.col("oldest"), F.col("newest")))
    if any(n == TOP for n, _ in used):
        # the newest year's newest document with any of the lines settles which one it is
        top = F.coalesce(*(F.when(F.col(t).isNotNull(), F.lit(i)) for i, t in enumerate(tops)))
        fixed = wide.filter((F.col("period") == F.col("newest")) & top.isNotNull()).groupBy("company").agg(F.max_by(top, "doc").alias("top"))
        wide = wide.join(fixed, "company", "left").withColumn("top", F.coalesce("top", F.lit(0)))
    count = lambda total, per: F.when((F.signum(total) == F.signum(per)) & (F.col(per) != 0), F.col(total).cast("double") / F.col(per).cast("double"))
    counts = F.array(*(count(*b) for b in bases)) if bases else F.array().cast("array<double>")
    each = []
    for name, tree in trees.items():
        value, reason = compiled(tree, lambda n, o: _term(n, o, tops))
        each.append(F.struct(F.lit(name).alias("name"), value.alias("value"), reason.alias("reason")))
    long = wide.select("company", "period", "doc", counts.alias("counts"), F.explode(F.array(*each)).alias("e")).select("company", "period", "doc", "e.name", "e.value", "e.reason", "counts")
    rank = F.struct(F.col("value").isNotNull().alias("v"), (F.col("reason") != "period_not_in_document").alias("r"), F.col("doc").alias("d"))
    return long.groupBy("company", "name", "period").agg(F.max_by(F.struct("doc", "value", "reason", "counts"), rank).alias("s")).select("company", "name", "period", "s.*")


def judged(facts: DataFrame, frames: DataFrame, conditions: list[TrendCondition], words: Vocabulary, trim: bool, tops: tuple[str, ...] = (), shares: Shares | None = None) -> DataFrame:
    """company, i (the condition's place), value, reason, at, from_period, to_period and docs (the years' sources) of every company and condition.

    A year without a value gives its reason to the series; the newest such year counts. With trim, a year before the
    documents' reach shortens the series instead, unless it is the newest. period_not_in_document otherwise becomes
    insufficient_history. Where an item a share is used and the number of shares grows or falls by JUMP in all its
    measures between two years, the reason is share_count_changed.
    """
    conditions = [c.checked() for c in conditions]
    exprs = {c.expr: c.expr for c in conditions}
    each = years(facts, frames, exprs, words, tops, shares)
    w = Window.partitionBy("company", "name")
    each = each.withColumns({"lost": F.max(F.when(F.col("value").isNull(), F.col("period"))).over(w), "top_period": F.max("period").over(w)})
    each = each.withColumn("why", F.max(F.when(F.col("period") == F.col("lost"), F.col("reason"))).over(w))
    cut = (F.lit(trim) & (F.col("why") == "period_not_in_document") & (F.col("lost") < F.col("top_period")))
    each = each.withColumn("why", F.when(F.coalesce(cut, F.lit(False)), None).when(F.col("why") == "period_not_in_document", "insufficient_history").otherwise(F.col("why")))
    kept = each.filter("why IS NULL AND (lost IS NULL OR period > lost)")
    failed = each.filter("why IS NOT NULL").groupBy("company", "name").agg(F.first("why").alias("reason"), F.first("lost").alias("at"))
    if shares:
        order = w.orderBy("period")
        growth = F.filter(F.zip_with("counts", F.lag("counts").over(order), lambda now, old: F.try_divide(now, old)), lambda q: q.isNotNull())
        jump = (F.size(growth) > 0) & (F.forall(growth, lambda q: q >= JUMP) | F.forall(growth, lambda q: q <= 1 / JUMP))
        shared = [n for n in exprs if any(t in shares.per_share for t, _ in terms(parse(n, words)))]
        kept = kept.withColumn("jump", F.when(F.col("name").isin(*shared) & F.coalesce(jump, F.lit(False)), F.col("period")) if shared else F.lit(None).cast("long"))
    else:
        kept = kept.withColumn("jump", F.lit(None).cast("long"))
    which = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c.expr).alias("expr"), F.lit(c.aggregate).alias("aggregate"), F.lit(c.year_least).cast("double").alias("lo"), F.lit(c.year_most).cast("double").alias("hi")) for i, c in enumerate(conditions)))
    mine = lambda name: F.explode(F.filter(which, lambda c: c.expr == name))
    rows = kept.select("company", "period", "value", "doc", "jump", mine(F.col("name")).alias("c")).select("company", "period", "value", "doc", "jump", "c.*")
    ends = rows.groupBy("company", "i").agg(F.min("period").alias("from_period"), F.max("period").alias("to_period"), F.min("jump").alias("jump"), F.array_sort(F.collect_set("doc")).alias("docs"))
    # years by number, as all steps are 12 months
    total = aggregated(rows.withColumn("period", F.floor(F.col("period") / 12)), F.coalesce("lo", "value"), F.coalesce("hi", "value"), ("company", "i", "aggregate")).drop("from_period", "to_period")
    names = {"mean": "mean", "min": "least", "max": "most", "streak_up": "streak_up", "streak_down": "streak_down", "years_meeting": "years_meeting", "change": "change", "ratio": "ratio", "cagr": "cagr"}
    value = F.coalesce(*(F.when(F.col("aggregate") == a, F.col(c).cast("double")) for a, c in names.items()))
    reason = F.when(F.col("aggregate").isin(*NEED_TWO) & (F.col("years") < 2), "insufficient_history").when(F.col("aggregate") == "ratio", F.col("why_ratio")).when(F.col("aggregate") == "cagr", F.col("why_cagr"))
    done = total.select("company", "i", value.alias("value"), reason.alias("reason")).join(ends, ["company", "i"])
    reason = F.when(F.col("jump").isNotNull(), "share_count_changed").otherwise(F.col("reason"))
    done = done.select("company", "i", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"), F.col("jump").alias("at"), "from_period", "to_period", "docs")
    lost = failed.select("company", mine(F.col("name")).alias("c"), "reason", "at").select("company", "c.i", F.lit(None).cast("double").alias("value"), "reason", "at")
    out = frames.filter("reason IS NOT NULL").select("company", F.explode(F.array(*map(F.lit, range(len(conditions))))).alias("i"), F.lit(None).cast("double").alias("value"), "reason", "at")
    return done.unionByName(lost.unionByName(out), allowMissingColumns=True)


def screened(judgements: DataFrame, conditions: list[TrendCondition]) -> DataFrame:
    """A row a company: stop (the first condition, in order, that it fails), reason (null if by its value), values by condition."""
    if not 1 <= len(conditions) <= MOST_CONDITIONS:
        raise ValueError(f"1 to {MOST_CONDITIONS} conditions")
    limits = lambda side: F.get(F.array(*(F.lit(getattr(c, side)).cast("double") for c in conditions)), F.col("i"))
    ok = F.col("value").isNotNull() & F.coalesce(F.col("value") >= limits("least"), F.lit(True)) & F.coalesce(F.col("value") <= limits("most"), F.lit(True))
    failing = F.when(~ok, F.struct("i", "reason", "at"))
    return judgements.groupBy("company").agg(F.min(failing).alias("s"), *(F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"v{i}") for i in range(len(conditions)))).select("company", F.col("s.i").alias("stop"), "s.reason", "s.at", *(f"v{i}" for i in range(len(conditions))))


def matched(rows: DataFrame, conditions: list[TrendCondition], order_by: int = 0, descending: bool = True, limit: int | None = None) -> DataFrame:
    """Companies that pass, by one condition's value and then company."""
    key = F.col(f"v{order_by}")
    out = rows.filter("stop IS NULL").orderBy(key.desc() if descending else key.asc(), "company").drop("stop", "reason", "at")
    return out.limit(limit) if limit else out


def excluded(rows: DataFrame, conditions: list[TrendCondition], examples: int = 5) -> DataFrame:
    """condition, reason, n, examples: whom a condition could not judge; each company counts once, where it stopped."""
    gone = rows.filter("reason IS NOT NULL").select(F.get(F.array(*(F.lit(c.name) for c in conditions)), F.col("stop")).alias("condition"), "reason", "company")
    first = F.row_number().over(Window.partitionBy("condition", "reason").orderBy("company"))
    some = gone.withColumn("_n", first).filter(F.col("_n") <= examples).groupBy("condition", "reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("company")), lambda c: c.cast("string")), ",").alias("examples"))
    return gone.groupBy("condition", "reason").agg(F.count("*").alias("n")).join(some, ["condition", "reason"])


def comparable(facts: DataFrame, rows: DataFrame, frames: DataFrame, conditions: list[TrendCondition], words: Vocabulary, trim: bool, shares: Shares) -> DataFrame:
    """A second pass over companies that stopped at share_count_changed: what can be compared instead.

    company, stop, value, why (the same aggregate of the profit, or its reason; null for years_meeting, whose limits are
    a share's), from_issued, to_issued (the issued shares at both ends of the series, from the newest document with them).
    """
    gone = rows.filter("reason = 'share_count_changed'").select("company", "stop")
    theirs = facts.join(gone.select("company"), "company", "left_semi")
    ours = frames.join(gone.select("company"), "company", "left_semi")
    again = [TrendCondition(c.aggregate if c.aggregate != "years_meeting" else "mean", shares.profit) for c in conditions]
    value = judged(theirs, ours, again, words, trim).select("company", F.col("i").alias("stop"), "value", F.col("reason").alias("why"), "from_period", "to_period")
    counting = F.col("stop").isin(*(i for i, c in enumerate(conditions) if c.aggregate == "years_meeting")) if any(c.aggregate == "years_meeting" for c in conditions) else F.lit(False)
    out = gone.join(value, ["company", "stop"]).withColumn("value", F.when(~counting, F.col("value")))
    issued = theirs.filter(F.col(shares.issued).isNotNull()).groupBy("company", "period").agg(F.max_by(shares.issued, F.struct("doc", "basis")).alias("issued"))
    return (
        out.join(issued.select("company", F.col("period").alias("from_period"), F.col("issued").alias("from_issued")), ["company", "from_period"], "left")
        .join(issued.select("company", F.col("period").alias("to_period"), F.col("issued").alias("to_issued")), ["company", "to_period"], "left")
        .select("company", "stop", "value", "why", "from_issued", "to_issued")
    )
