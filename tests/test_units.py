"""Expressions, periods, text functions, readers, writers and streams on small frames."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import periods, text
from quillstone.operators import checks, curation, retrieval, screen, series, trend, usage
from quillstone.operators.expr import ExpressionError, Vocabulary, parse, terms
from quillstone.sources import formats, sinks
from quillstone.streaming import usage as stream

WORDS = Vocabulary(frozenset({"a", "b"}), {"growth": "a[t] / a[t-1] - 1", "deep": "growth[t-2]"}, frozenset({"c"}))


def test_parse_shapes():
    assert parse("a - b - 1", WORDS) == ("-", ("-", ("term", "a", 0), ("term", "b", 0)), ("num", "1"))
    assert parse("-a * (b + .5)", WORDS) == ("*", ("neg", ("term", "a", 0)), ("+", ("term", "b", 0), ("num", ".5")))
    assert list(terms(parse("deep", WORDS))) == [("a", 2), ("a", 3)]


@pytest.mark.parametrize("expr,reason", [("", "bad_expression"), ("a +", "bad_expression"), ("f(a)", "unknown_item"), ("a[t+1]", "bad_expression"), ("a[t-5]", "bad_expression"), ("growth[t-4]", "bad_expression"), ("c", "input_not_ingested"), ("'a'", "bad_expression"), ("a > b", "bad_expression"), ("a" * 301, "bad_expression"), ("+".join(["a"] * 21), "bad_expression")])
def test_refused(expr, reason):
    with pytest.raises(ExpressionError) as e:
        parse(expr, WORDS)
    assert e.value.reason == reason


def test_candidates_for_a_misspelling():
    with pytest.raises(ExpressionError) as e:
        parse("growht", WORDS)
    assert e.value.candidates == ["growth"]


def test_reasons(spark):
    rows = [("x", 3, "consolidated", 3, 10, 1), ("x", 3, "consolidated", 2, 0, 1), ("y", 3, "consolidated", 3, 5, 1), ("z", 3, "consolidated", 3, 5, 1), ("z", 3, "consolidated", 1, 5, 1), ("w", 3, "consolidated", 3, None, 1), ("w", 3, "consolidated", 2, 4, 1), ("v", 3, "consolidated", 3, 6, 1), ("v", 3, "consolidated", 2, 4, 1)]
    facts = spark.createDataFrame(rows, "company string, doc int, basis string, period int, a int, b int")
    got = {r.company: (r.c_g, r.why_g) for r in screen.evaluated(facts, [screen.Condition("g", "growth")], WORDS).collect()}
    assert {k: v[1] for k, v in got.items()} == {"x": "nonpositive_denominator", "y": "period_not_in_document", "z": "irregular_period", "w": "input_not_disclosed", "v": None}
    assert float(got["v"][0]) == 0.5


def test_trend_aggregates(spark):
    rows = [("up", y, v) for y, v in ((1, 1.0), (2, 2.0), (3, 4.0))] + [("one", 1, 1.0), ("gap", 1, 1.0), ("gap", 3, 1.0), ("zero", 1, 0.0), ("zero", 2, 1.0), ("neg", 1, 1.0), ("neg", 2, -1.0)]
    got = {r.company: r for r in trend.aggregated(spark.createDataFrame(rows, "company string, period int, value double"), least=1.5, most=9).collect()}
    assert (got["up"].cagr, got["up"].streak_up, got["up"].streak_down, got["up"].years_meeting) == (1.0, 2, 0, 2)
    assert [got[k].why_cagr for k in ("one", "gap", "zero", "neg")] == ["insufficient_history", "irregular_period", "nonpositive_start", "negative_end"]


def test_periods(spark):
    df = spark.createDataFrame([("2024-02-28E", 2), ("FY2021H2", 1), ("2020-01", -1), ("13", 1), (None, 1)], "p string, n int")
    assert [r[0] for r in df.select(periods.shifted(F.col("p"), F.col("n"))).collect()] == ["2024-03-01E", "FY2022H1", "2019-12", None, None]
    assert spark.range(1).select(periods.months_between(F.lit("2020-11"), F.lit("2022-01"))).first()[0] == 14


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.name_key(F.lit("ＡＢＣ 株式会社"))) == "abc"
    assert value(text.char_shingles(F.lit("abcdef"))) == ["abcde", "bcdef"] and value(text.char_shingles(F.lit("abc"))) == ["abc"]
    assert value(text.sentences(F.lit("v. 2.0 Two!\nThree。四"))) == ["v. 2.0 Two!", "Three。", "四"]
    assert value(text.sentences(F.lit("One. Two!\nThree。四"), ".!?。！？")) == ["One.", "Two!", "Three。", "四"]
    assert [value(text.client_label(F.lit(a))) for a in ("Claude-User/2", "claude-users", "openai-mcp/1", "openai-mcp", None)] == ["claude", "other", "chatgpt", "other", "other"]
    assert value(text.mentioned(F.lit("the abc, a"), {"x": ["abc"], "y": ["a", "the a"]})) == ["y"]
    assert value(text.bounded_parts(F.array(*map(F.lit, ["aa", "bb", "cccccccc", "d"])), 5)) == ["aa bb", "cccccccc", "d"]
    assert [value(text.column_letters(F.lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert value(text.plain_decimal(F.lit("1.500").cast("decimal(10,3)"))) == "1.5"
    assert value(text.cell_number(F.lit("△ 1,234.5"))) == -1234.5 and value(text.cell_number(F.lit("n/a"))) is None
    assert [value(text.is_number(F.lit(x))) for x in ("-1.5e3", "1,000", "-", "…")] == [True, False, False, False]
    assert value(text.unit_id(F.lit("a#page#1"))) == value(text.unit_id(F.lit("a#page#1")))


def test_layers(spark):
    chunks = spark.createDataFrame([(1, "public", "o"), (2, "restricted", "o"), (3, None, "o")], "id int, layer string, org string")
    with pytest.raises(retrieval.LayerError):
        retrieval.search_filter(chunks, [])
    assert [r.id for r in retrieval.search_filter(chunks, ["public"]).collect()] == [1]


def test_fold_keeps_the_newest(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, 10, 1, "s", 1, t), (1, 11, 2, "s", 2, t + "."), (1, 12, 3, "r", 3, t), (1, 13, 4, "s", 1, "entirely different words here")]
    got = retrieval.folded(spark.createDataFrame(rows, "query_id long, id long, rank int, series string, version int, text string")).orderBy("rank").collect()
    assert [(r.id, r.rank, r.older) for r in got] == [(11, 1, [10]), (12, 3, []), (13, 4, [])]


def test_sum_check_gap_inside_a_span(spark):
    children = spark.createDataFrame([("k", "x", 1, 1.0), ("k", "x", 3, 1.0), ("k", "y", 1, 1.0), ("k", "y", 2, 1.0), ("k", "y", 3, 1.0)], "k string, child string, p int, value double")
    parents = spark.createDataFrame([("k", 1, 9.0), ("k", 2, 1.0), ("k", 3, 2.0)], "k string, p int, value double")
    got = checks.sum_check(children, parents, ["k"], "p").orderBy("p").collect()
    assert [r.ok for r in got] == [False, False, True] and got[0].consistent_from == 3


def test_collapse_and_finest(spark):
    rows = spark.createDataFrame([("a", "f", "q"), ("b", "f", "m"), ("c", "g", "a")], "series_id string, fam string, freq string")
    assert {(r.series_id, r.kind) for r in series.collapsed(rows, ["fam"], 1).collect()} == {("a", "card"), ("c", "row")}
    assert {r.series_id for r in series.finest(rows, ["fam"], {"m": 0, "q": 1, "a": 2}).collect()} == {"b", "c"}


def test_html(spark):
    page = "<html><nav>x</nav><main><p>Hello</p><a href='/u'> a  b </a></main><p>out</p><table><tr><td rowspan=2>1</td><td colspan=2>2</td></tr><tr><td>3</td><td>4</td></tr></table></html>"
    assert formats.article_text(page) == "Hello\na  b" and formats.article_text(None) is None
    r = spark.createDataFrame([(page,)], "html string").select(formats.html_anchors("html").alias("a"), formats.html_cells("html").alias("c")).first()
    assert [(a.href, a.label) for a in r.a] == [("/u", "a b")]
    assert [(c.row, c.col, c.text) for c in r.c] == [(0, 0, "1"), (0, 1, "2"), (0, 2, "2"), (1, 0, "1"), (1, 1, "3"), (1, 2, "4")]


def test_xbrl_conflicts_are_errors():
    one = "<x><n:Sales xmlns:n='u' contextRef='c' decimals='-6'>{}</n:Sales><n:Sales xmlns:n='u' contextRef='c'>{}</n:Sales></x>"
    assert formats.xbrl_facts(one.format(5, 5))[0]["value"] == "5"
    with pytest.raises(ValueError):
        formats.xbrl_facts(one.format(5, 6))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    sinks.swap_version(df, str(tmp_path / "t"), "v1")
    sinks.swap_version(df.filter("x = 1"), str(tmp_path / "t"), "v2")
    assert sinks.current(spark, str(tmp_path / "t")).count() == 1
    assert sinks.fingerprint(df).first() == sinks.fingerprint(df.orderBy(F.desc("x"))).first()
    sinks.replace_partitions(df, str(tmp_path / "p"), "k", ["x"])
    sinks.replace_partitions(df.filter("k = 'a'").withColumn("x", F.lit(9)), str(tmp_path / "p"), "k", ["x"])
    assert {(r.x, r.k) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(9, "a"), (2, "b")}
    sinks.append_events(df, str(tmp_path / "log"))
    sinks.append_events(df, str(tmp_path / "log"))
    assert formats.log_records(spark, str(tmp_path / "log"), "x int, k string").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('# note\n{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in formats.json_lines(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "w.csv").write_text("id,2020,2021\nx,1.50,\n")
    got = formats.unpivoted(formats.csv_rows(spark, str(tmp_path / "w.csv")), ["id"]).collect()
    assert [tuple(r) for r in got] == [("x", "2020", "1.50")]


def test_stream_upsert_adds_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    df.write.parquet(src)
    for _ in range(2):
        df.write.mode("append").parquet(src)
        stream.upsert_stream(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / "cp"), "k").awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "", "1")], "k string, t string, v string")
    new = spark.createDataFrame([("a", "y", "2"), ("b", "y", "2"), ("c", "y", "2")], "k string, t string, v string")
    assert {tuple(r) for r in curation.upsert_sticky(old, new, "k", ["t"]).collect()} == {("a", "x", "2"), ("b", "y", "2"), ("c", "y", "2")}
    assert curation.not_yet_by_prefix(spark.createDataFrame([("b",), ("x",)], "k string"), spark.createDataFrame([("b_1",)], "k string"), "k").collect() == [("x",)]


def test_cell_flags_without_aggregate_or_members(spark):
    d = spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.1), ("p", 0.2), ("z", 0.0)], "series_id string, dispersion double")
    parents = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "z")], "series_id string, parent string")
    flags = series.volatile(d, parents)
    assert {r.series_id: r.volatile for r in flags.collect()} == {"a": True, "b": False, "c": False}
    members = spark.createDataFrame([("a", 1, 500.0), ("a", 2, 99.0), ("b", 1, 5.0), ("b", 2, 100.0), ("x", 1, 3.0), ("x", 2, None)], "series_id string, at int, value double")
    assert {tuple(r) for r in series.cell_flags(flags, members).collect()} == {("a", "volatile,small_cell"), ("x", "small_cell")}


def test_id_parts_takes_the_longest_measure_and_ending(spark):
    c = spark.createDataFrame([("o.d.m.x.a", "o", "d", "m", "x", "a"), ("o.d.m.n.x.a", "o", "d", "m.n", "x", "a"), ("o.d.m.x.a.r", "o", "d", "m", "x", "a"), ("o.d.k.a", "o", "d", "k", None, "a")], "series_id string, org string, dataset string, measure string, dims string, freq string")
    ids = spark.createDataFrame([("o.d.m.n.y.a",), ("o.d.m.y.a.r",), ("o.d.k.a",), ("o.e.m.x.a",), ("o.d.m.y.q",), ("",), ("o",)], "series_id string")
    got = {r.series_id: tuple(r)[1:] for r in series.id_parts(ids, c).collect()}
    assert got["o.d.m.n.y.a"] == ("o", "d", "m.n", "y", "a") and got["o.d.m.y.a.r"] == ("o", "d", "m", "y", "a") and got["o.d.k.a"] == ("o", "d", "k", "", "a")
    assert all(got[x] == (None,) * 5 for x in ("o.e.m.x.a", "o.d.m.y.q", "", "o"))


def test_id_sets_retention_and_versions(spark):
    from datetime import datetime

    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 2, None], [2, 3, 3]))
    assert tuple(checks.same_ids(a, b, "k").first()) == (1, 1, 1, False)
    assert tuple(checks.same_ids(a.limit(0), b.limit(0), "k").first()) == (0, 0, 0, True)
    log = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (3, None)], "n int, ts timestamp")
    assert sorted(r.n for r in usage.retained(log, "ts", datetime(2024, 2, 1)).collect()) == [2, 3]
    names = spark.createDataFrame([("gov_a_1.pdf",), ("gov_a",), ("org_a_1",), (None,)], "n string")
    assert [r.v for r in names.select(text.version_key(F.col("n"), ["gov"]).alias("v")).collect()] == ["gov_a", None, None, None]


@pytest.mark.parametrize("value,want", [(None, 1), ("", 1), ("2", 2), ("2%", 2), (" 3", 3), ("+4", 4), ("0", 1), ("-1", 1), ("x", 1), ("99999999999", 1000)])
def test_spans_are_read_as_browsers_do(value, want):
    assert formats.span(value, 1000) == want


def test_no_cell_reaches_below_its_table():
    cells = formats.table_cells("<table><tr><td rowspan='70000'>a</td><td colspan='2%'>b</td></tr><tr><td>c</td></tr></table>")
    assert [(x["row"], x["col"], x["text"]) for x in cells] == [(0, 0, "a"), (0, 1, "b"), (0, 2, "b"), (1, 0, "a"), (1, 1, "c")]
