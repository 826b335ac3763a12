"""Tables by region: the grid of merged cells, pairs of labelled values, the ratio and its reasons."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import regions as rg

ROWS = "array<array<struct<text:string,rowspan:int,colspan:int,tables:int>>>"
SECTIONS = f"company int, doc string, basis string, section string, context string, period string, content {rg.CONTENT}"
REQUESTS = "company int, doc string, basis string, period string, ifrs boolean, tagged long"


def cells(*rows):
    """Rows of texts, or of (text, rowspan, colspan)."""
    return [[(c, None, None, None) if not isinstance(c, tuple) else (*c, None) for c in row] for row in rows]


def table(*rows):
    return ("table", None, cells(*rows))


def placed(rows):
    """The places of the cells by filling a dictionary."""
    taken, n = {}, 0
    for r, row in enumerate(rows):
        c = 0
        for text, height, width, _ in row:
            while (r, c) in taken:
                c += 1
            for dr in range(max(height or 1, 1)):
                for dc in range(max(width or 1, 1)):
                    if r + dr < len(rows):
                        taken[r + dr, c + dc] = (n, text)
            c, n = c + max(width or 1, 1), n + 1
    return sorted((r, c, *v) for (r, c), v in taken.items())


def test_merged_cells_take_the_places_that_they_cover(spark):
    rng = random.Random(5)
    tables = [cells([("a", 2, 1), ("b", 1, 2), "c"], ["d", ("e", 1, 1), "f"]), cells(["x"]), cells([], ["y"])]
    for _ in range(60):  # spans that never run into a cell from above: widths of one wherever a cell reaches down
        rows = [[(f"{r}.{k}", rng.choice([None, 1, 2, 3, 0]), 1, None) for k in range(rng.randint(0, 5))] for r in range(rng.randint(1, 5))]
        rows[0] = [(f"h{k}", 1, rng.randint(1, 3), None) for k in range(3)]
        tables.append(rows)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], f"id int, rows {ROWS}")
    got = {r.id: sorted(map(tuple, r.g)) for r in df.select("id", rg.grid(F.col("rows")).alias("g")).collect()}
    assert got == {i: placed(t) for i, t in enumerate(tables)}


@pytest.mark.parametrize("text,number", [("1,234", 1234), ("１，２３４ 千円", 1234), ("12", 12), ("12,34", None), ("△5", None), ("－", None), ("", None), ("1 000", 1000), ("3百万円", 3)])
def test_numbers(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(rg.number_of(F.col("t"))).first()[0]
    assert got == number


def test_labels_and_fillers(spark):
    rows = [("日 本（注）1", "日本", False), ("国内 (千円)", "国内(千円)", False), ("合計※2", "合計", False), ("（単位：百万円）", None, True), ("　", None, True), ("該当事項はありません。", None, True)]
    df = spark.createDataFrame(rows, "t string, label string, filler boolean")
    for r in df.select("*", rg.label_of(F.col("t")).alias("l"), rg.is_filler(F.col("t")).alias("f")).collect():
        assert r.f == r.filler and (r.label is None or r.l == r.label)


def ratio(spark, sections, requests=None, trend=False):
    requests = requests or [(1, "d", "c", "2024-03", False, 1_000_200)]
    rows = rg.overseas_ratio(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(sections, SECTIONS), trend).collect()
    return rows[0] if len(rows) == 1 else rows


def section(*content, kind="revenue", context="CurrentYearDuration", period="2024-03", doc="d"):
    return (1, doc, "c", kind, context, period, list(content))


def test_ratio_of_a_plain_table(spark):
    got = ratio(spark, [section(("text", "所在地を基礎とする", None), table(["", "日本", "米国", "合計"], ["売上高", "600", "400", "1,000"]))])
    assert (got.value, got.reason, got.home_text, got.total_text, got.unit, got.table, got.notes) == (0.4, None, "600", "1,000", 1000, 0, ["所在地を基礎とする"])


def test_of_columns_with_both_years_the_one_that_is_tagged_counts(spark):
    got = ratio(spark, [section(table(["", "前期", "当期"], ["本邦", "500", "700"], ["海外", "300", "300"], ["計", "800", "1,000"]))])
    assert (got.value, got.home_text) == (0.3, "700")


def test_one_merged_cell_is_one_pair_and_two_cells_are_two(spark):
    merged = [["", ("日本", 1, 2), ("合計", 2, 1)], ["", "a", "b"]]
    one = ratio(spark, [section(table(*merged, ["売上", ("900", 1, 2), "1,000"]))])
    assert (one.value, one.reason) == (0.1, None)
    two = ratio(spark, [section(table(*merged, ["売上", "300", "600", "1,000"]))])
    assert (two.value, two.reason, two.why) == (None, "home_or_total_not_identified", "2 pairs")
    same = ratio(spark, [section(table(*merged, ["売上", "500", "500", "1,000"]))])
    assert (same.value, same.reason) == (0.5, None)


@pytest.mark.parametrize(
    "content,value,reason",
    [
        ([("text", "本邦以外の外部顧客への売上高はありません。", None)], 0.0, None),
        ([table(["本邦のみで事業を行っております。"])], 0.0, None),
        ([("text", "本邦の売上高が９０％を超える", None)], None, "overseas_statement_only"),
        ([("text", "記載を省略しております", None)], None, "regions_omitted"),
        ([], None, "regions_omitted"),
        ([table(["北米", "合計"], ["600", "1,000"])], None, "home_not_in_table"),
        ([table(["日本", "合計"], ["600", "2,000"])], None, "home_or_total_not_identified"),
        ([table(["日本", "合計"], ["－", "1,000"])], None, "home_or_total_not_identified"),
        ([table(["日本", "合計"], ["60.5", "1,000"])], None, "home_or_total_not_identified"),
    ],
)
def test_reasons(spark, content, value, reason):
    got = ratio(spark, [section(*content)])
    assert (got.value, got.reason) == (value, reason)


def test_without_a_tagged_figure_or_a_section(spark):
    assert ratio(spark, [section(table(["日本", "合計"], ["1", "2"]))], [(1, "d", "c", "2024-03", False, None)]).why == "no tagged revenue"
    assert ratio(spark, [section(kind="other")]).reason == "regions_not_tagged"
    assert ratio(spark, [section(context="Prior1YearDuration")]).reason == "regions_not_tagged"
    assert rg.overseas_ratio(spark.createDataFrame([], REQUESTS), spark.createDataFrame([], SECTIONS)).collect() == []


def test_a_trend_reads_the_year_before_from_a_later_document(spark):
    wide = table(["", "前期", "当期"], ["日本", "400", "700"], ["合計", "1,000", "1,500"])
    sections = [section(table(["日本", "合計"], ["400", "1,000"]), context="Prior1YearDuration", period="2023-03"), section(wide, kind="geographic_areas_ifrs")]
    asked = lambda ifrs: [(1, "d", "c", "2023-03", ifrs, 1_000_000)]
    assert ratio(spark, sections, asked(False), trend=True).value == 0.6
    assert ratio(spark, sections, asked(True), trend=True).value == 0.6
    assert ratio(spark, sections, asked(False)).reason == "regions_not_tagged"
    assert ratio(spark, sections, [(1, "d", "c", "2021-03", False, 1)], trend=True).reason == "regions_not_in_document"


def test_regions_of_a_period(spark):
    t = table(["日本", "合計"], ["4", "10"])
    sections = [section(t, doc="a"), section(t, doc="b", context="Prior1YearDuration"), section(t, doc="b", period="2025-03"), section(t, doc="i", kind="geographic_areas_ifrs", period="2027-03"), section(("text", "省略", None), doc="o", period="2029-03")]
    docs = [(1, "a", "2024-06", "2024-03", "2023-03"), (1, "b", "2025-06", "2025-03", "2024-03"), (1, "i", "2027-06", "2027-03", "2026-03"), (1, "n", "2028-06", "2028-03", None), (1, "o", "2029-06", "2029-03", None)]
    asked = [(1, "c", p) for p in ("2023-03", "2024-03", "2025-03", "2026-03", "2028-03", "2029-03", "2031-03")]
    out = rg.region_sections(spark.createDataFrame(asked, "company int, basis string, period string"), spark.createDataFrame(docs, "company int, doc string, submitted string, current string, prior string"), spark.createDataFrame(sections, SECTIONS))
    got = {r.period: (r.found, r.reason, r.doc, r.other_docs, r.sections and [s.period_in_columns for s in r.sections]) for r in out.collect()}
    assert got == {
        "2023-03": (False, "not_tagged", "a", 0, None), "2024-03": (True, None, "b", 1, [False]), "2025-03": (True, None, "b", 0, [False]), "2026-03": (True, None, "i", 0, [True]),
        "2028-03": (False, "not_tagged", "n", 0, None), "2029-03": (False, "omitted", "o", 0, [False]), "2031-03": (False, "out_of_range", None, 0, None),
    }


def test_copies_that_differ_from_their_source(spark):
    nested = ("table", None, [[("x", None, None, 2)]])
    rows = [(*section(nested), 3), (*section(nested, period="2025-03"), 1), (*section(("table", None, [[(None, None, None, None)]]), period="2026-03"), 1)]
    got = {r.period: r.why for r in rg.unfaithful_copies(spark.createDataFrame(rows, SECTIONS + ", source_tables int")).collect()}
    assert got == {"2025-03": "3 of 1", "2026-03": "cell without text"}
