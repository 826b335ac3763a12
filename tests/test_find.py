"""Finding series: order, the three axes one after another, totals, and diagnoses of finding nothing."""

import pytest

from quillstone.operators import find

CATALOG = "series_id string, dataset string, measure string, dims string, freq string, specificity int, title string, notes string, stat_name string, table_title string, scope string, superseded_by string, tags array<string>"


def series(id_, dataset="d", measure="m", dims="all", freq="a", spec=0, title="Sales", notes="", scope="jp", old=None, tags=("x",)):
    return (id_, dataset, measure, dims, freq, spec, title, notes, "", "", scope, old, list(tags))


def found(spark, rows, words=(), axes=find.Axes(), **more):
    out = find.find(spark.createDataFrame(rows, CATALOG), list(words), axes, **more).collect()
    return [r.name for r in out if r.kind == "row"], {(r.axis, r.name): (r.members, r.first, r.freqs) for r in out if r.kind == "family"}, out and (out[0].total, out[0].shown, out[0].truncated)


def test_order_of_rows(spark):
    rows = [series("z"), series("y", spec=1), series("a", title="other", notes="sales"), series("b", dataset="old"), series("c", dataset="old", old="n"), series("e", scope="intl"), series("none", title="x")]
    assert found(spark, rows, ["SALES"])[0] == ["z", "e", "b", "c", "a", "y"]


def test_dimensions_collapse_beyond_three_and_the_whole_stays(spark):
    rows = [series("whole")] + [series(f"p{i}", dims=f"p{i}", spec=1) for i in range(4)] + [series(f"q{i}", measure="n", dims=f"q{i}", spec=1) for i in range(3)]
    assert found(spark, rows) == (["whole", "q0", "q1", "q2"], {("dims", "d.m.a"): (4, "p0", "a")}, (8, 4, False))
    assert len(found(spark, rows, expand=True)[0]) == 8


def test_variants_collapse_but_for_the_whole_and_what_dimensions_took(spark):
    axes = find.Axes(variant_datasets=("v",), items=("gdp", "use", "use_home"))
    rows = [series(f"{i}.{k}", "v", f"{i}_{k}") for i in ("gdp", "use", "use_home") for k in ("real", "dfl")] + [series("odd", "v", "other_real"), series("w", "w", "use_real")]
    rows += [series(f"s{i}", "v", "use_real", f"x{i}", spec=1) for i in range(4)]
    names, families, _ = found(spark, rows, axes=axes)
    assert names == ["gdp.dfl", "gdp.real", "odd", "w"]
    assert families == {("dims", "v.use_real.a"): (4, "s0", "a"), ("variant", "v.real.all.a"): (2, "use.real", "a"), ("variant", "v.dfl.all.a"): (2, "use.dfl", "a")}
    assert found(spark, [r for r in rows if not r[0].startswith("use_home")], axes=axes)[1].keys() == {("dims", "v.use_real.a")}


def test_frequencies_collapse_to_the_finest_unless_asked_for(spark):
    axes = find.Axes(freq_datasets=("f",))
    rows = [series(f"g.{f}", "f", "gap", freq=f) for f in ("a", "fy", "q", "zz")] + [series("h.a", "f", "one"), series("i.q", "o", "gap", freq="q"), series("i.a", "o", "gap")]
    assert found(spark, rows, axes=axes)[:2] == (["g.q", "h.a", "i.a", "i.q"], {("freq", "f.gap.all"): (3, "g.a", "a,fy,zz")})
    assert found(spark, rows, axes=axes, freq="a")[:2] == (["g.a", "h.a", "i.a"], {})


def test_limits_and_totals(spark):
    rows = [series(f"{i:03}", measure=f"m{i}") for i in range(70)]
    names, _, totals = found(spark, rows, limit=5)
    assert names == ["000", "001", "002", "003", "004"] and totals == (70, 5, True)
    assert len(found(spark, rows, limit=500)[0]) == 50 and len(found(spark, rows, limit=0)[0]) == 1
    assert found(spark, rows, ["nothing"]) == ([], {}, []) and found(spark, []) == ([], {}, [])
    assert found(spark, rows, tags=["y"])[0] == []


@pytest.mark.parametrize(
    "words,facets,counts,hint",
    [
        (["sales", "tea"], {}, [(2, 2), (0, 0)], "fewer_words"), (["tea"], {}, [(0, 0)], "not_held"), (["sales"], {"dataset": "none"}, [(0, 2)], "other_facets"),
        (["sales", "coal"], {"dataset": "e", "tags": ["x"]}, [(1, 2), (0, 1)], "fewer_words"), (["coal"], {"tags": ["y"]}, [(0, 1)], "other_facets"), (["tea"], {"dataset": "d"}, [(0, 0)], "not_held"),
    ],
)
def test_why_nothing_was_found(spark, words, facets, counts, hint):
    rows = [series("a"), series("b", dataset="e"), series("c", title="Coal")]
    got = find.diagnosis(spark.createDataFrame(rows, CATALOG), words, **facets).collect()
    assert [(r.word, r.n, r.n_unfiltered, r.hint) for r in got] == [(w, *c, hint) for w, c in zip(words, counts)]
