"""Screens over series: order of reasons, one standard and line along a series, where companies stop, what can be compared."""

import pytest

from quillstone.operators import trend_screen as ts
from quillstone.operators.expr import Vocabulary

WORDS = Vocabulary(frozenset({"a", "b", "eps", ts.TOP}), {"g": "a[t] / a[t-1] - 1"}, frozenset())
DDL = "company string, doc int, declared string, standard string, basis string, period long, a double, b double, eps double"
M = lambda year, month=12: year * 12 + month


def filings(company, values, standard="JP", basis="consolidated", reach=2, **eps):
    """A document a year with that year and the one before it."""
    rows = []
    for y in values:
        for back in range(reach):
            if y - back in values:
                v = values[y - back]
                rows.append((company, y, standard, standard, basis, M(y - back), v, 1.0, eps.get("eps", {}).get(y - back)))
    return rows


def frames(spark, rows, first=M(2000), last=M(2003)):
    return {r.company: (r.reason, r["at"], r.basis, r.standard) for r in ts.frame(spark.createDataFrame(rows, DDL), first, last).collect()}


def judge(spark, rows, *conditions, trim=True, first=M(2000), last=M(2003), tops=(), shares=None):
    f = spark.createDataFrame(rows, DDL)
    fr = ts.frame(f, first, last)
    return f, fr, ts.judged(f, fr, list(conditions), WORDS, trim, tops, shares)


FOUR = {2000: 10.0, 2001: 20.0, 2002: 30.0, 2003: 80.0}


def test_reasons_of_a_frame_in_order(spark):
    rows = filings("late", {2001: 1.0, 2002: 1.0, 2003: 1.0}) + filings("early", {2000: 1.0, 2001: 1.0}) + filings("none", {1990: 1.0}) + filings("future", {2010: 1.0})
    rows += filings("gap", {2000: 1.0, 2001: 1.0, 2003: 1.0}) + filings("ok", FOUR)
    rows += [r for r in filings("basis", FOUR) if r[5] != M(2001)] + [("basis", 2001, "JP", "JP", "non_consolidated", M(2001), 1.0, 1.0, None)]
    got = {k: v[0] for k, v in frames(spark, rows).items()}
    assert got == {"late": "insufficient_history", "early": "insufficient_history", "none": "no_period_in_window", "future": "no_period_in_window", "gap": "irregular_period", "ok": None, "basis": "basis_changed"}


def test_a_gap_before_the_window_counts_at_its_first_year(spark):
    assert frames(spark, filings("c", {1998: 1.0, **FOUR}))["c"][:2] == ("irregular_period", M(2000))


def test_newest_document_sets_basis_and_standard(spark):
    rows = filings("c", FOUR, "US", "non_consolidated") + [("c", 2003, "US", "US", "consolidated", M(2002), 1.0, 1.0, None)]
    assert frames(spark, rows)["c"][2:] == ("non_consolidated", "US")


def test_values_come_from_the_newest_document_with_all_inputs(spark):
    rows = filings("c", FOUR) + [("c", 2009, "JP", "JP", "consolidated", M(2000), 99.0, 1.0, None)]
    _, _, out = judge(spark, rows, ts.TrendCondition("min", "a"), ts.TrendCondition("change", "a"), ts.TrendCondition("max", "g"))
    got = {r.i: (r.value, r.reason, r.from_period) for r in out.collect()}
    assert got == {0: (20.0, None, M(2000)), 1: (-19.0, None, M(2000)), 2: (pytest.approx(80 / 30 - 1), None, M(2001))}


def test_without_trimming_a_year_out_of_reach_is_too_short_a_history(spark):
    _, _, out = judge(spark, filings("c", FOUR), ts.TrendCondition("max", "g"), trim=False)
    assert [(r.reason, r["at"]) for r in out.collect()] == [("insufficient_history", M(2000))]


def test_standard_and_line_stay_along_a_series(spark):
    other = [(c, d, "JP", "US" if p < M(2002) else s, b, p, *v) for c, d, _, s, b, p, *v in filings("std", FOUR)]
    line = [(*r[:6], None if r[5] < M(2002) else r[6], *r[7:]) for r in filings("line", FOUR)]
    _, _, out = judge(spark, other + line, ts.TrendCondition("cagr", ts.TOP), ts.TrendCondition("mean", "b"), tops=("a", "b"))
    got = {(r.company, r.i): (r.reason, r["at"]) for r in out.collect()}
    assert got == {("std", 0): ("standard_changed", M(2001)), ("std", 1): ("standard_changed", M(2001)), ("line", 0): ("top_line_changed", M(2001)), ("line", 1): (None, None)}


def test_aggregates_and_their_reasons(spark):
    rows = filings("c", {2000: -1.0, 2001: 5.0, 2002: 7.0, 2003: 9.0}) + filings("d", {2000: 4.0, 2001: 3.0, 2002: 3.0, 2003: -1.0})
    _, _, out = judge(spark, rows, *(ts.TrendCondition(a, "a", year_least=4.0) for a in ("cagr", "streak_up", "streak_down", "years_meeting")))
    got = {(r.company, r.i): r.value if r.reason is None else r.reason for r in out.collect()}
    assert got == {("c", 0): "nonpositive_start", ("c", 1): 3, ("c", 2): 0, ("c", 3): 3, ("d", 0): "negative_end", ("d", 1): 0, ("d", 2): 1, ("d", 3): 1}


def test_companies_stop_at_the_first_failing_condition(spark):
    rows = filings("good", FOUR) + filings("low", {y: 1.0 for y in FOUR}) + filings("bad", {2000: -1.0, 2001: 1.0, 2002: 1.0, 2003: 1.0})
    conditions = [ts.TrendCondition("mean", "a", least=0.0), ts.TrendCondition("ratio", "a", least=2.0), ts.TrendCondition("cagr", "a")]
    _, _, out = judge(spark, rows, *conditions)
    done = ts.screened(out, conditions)
    assert {r.company: (r.stop, r.reason) for r in done.collect()} == {"good": (None, None), "low": (1, None), "bad": (1, "nonpositive_start")}
    assert [r.company for r in ts.matched(done, conditions, 1).collect()] == ["good"]
    assert [tuple(r) for r in ts.excluded(done, conditions).collect()] == [("ratio:a", "nonpositive_start", 1, "bad")]
    with pytest.raises(ValueError):
        ts.screened(out, conditions * 2)


def test_share_counts_and_what_compares_instead(spark):
    eps = {2000: 1.0, 2001: 2.0, 2002: 1.0, 2003: 8 / 3}  # a / eps: 10, 10, 30, 30
    shares = ts.Shares(frozenset({"eps"}), (("a", "eps"),), "a", "b")
    conditions = [ts.TrendCondition("change", "eps")]
    f, fr, out = judge(spark, filings("c", FOUR, eps=eps) + filings("d", FOUR, eps={y: v / 10 for y, v in FOUR.items()}), *conditions, shares=shares)
    done = ts.screened(out, conditions)
    assert {r.company: (r.reason, r["at"]) for r in done.collect()} == {"c": ("share_count_changed", M(2002)), "d": (None, None)}
    assert [tuple(r) for r in ts.comparable(f, done, fr, conditions, WORDS, True, shares).collect()] == [("c", 0, 70.0, None, 1.0, 1.0)]


def test_requests_and_windows(spark):
    assert ts.default_window(M(2026, 9)) == (M(2013, 6), M(2026, 5))
    for bad in (ts.TrendCondition("median", "a"), ts.TrendCondition("years_meeting", "a")):
        with pytest.raises(ValueError):
            bad.checked()
    assert ts.frame(spark.createDataFrame([], DDL), M(2000), M(2003)).count() == 0
