"""Layouts of sheets on small cases: levels that are skipped, defects of whole sheets, and what can't be settled."""

from quillstone.operators import layouts as lo

CELLS = "sheet string, row int, col int, text string"
LAYOUT = lo.Statements((("資産の表", "A"), ("費用の表", "B")), {"北": "N", "南": "S"}, ("一般", "全体"))
HEADS = [("s", 4, 7, "北"), ("s", 4, 9, " 南 "), *(("s", row, 7 + i, ("一般", "全体")[i % 2]) for row in (6, 21) for i in range(4))]
BODY = [("s", 5, 1, "資産の表（円）"), ("s", 20, 1, "費用の表"), ("s", 7, 2, "科目"), ("s", 8, 2, "土 地"), ("s", 9, 4, "山"), ("s", 10, 3, "畑"), ("s", 11, 4, "茶"), ("s", 12, 1, "合計"), ("s", 13, 4, "別"), ("s", 22, 3, "給与"), ("s", 23, 1, "指標"), ("s", 24, 2, "外")]


def frame(spark, rows, ddl=CELLS):
    return spark.createDataFrame(rows, ddl)


def defects(spark, rows):
    cells = frame(spark, rows)
    return sorted((r.defect, r.n, r.places) for r in lo.sheet_defects(lo.statement_columns(cells, lo.statement_rows(cells, LAYOUT), LAYOUT)).collect())


def test_paths_end_at_labels_further_left_totals_and_sections(spark):
    rows = lo.statement_rows(frame(spark, HEADS + BODY), LAYOUT).filter("path IS NOT NULL").collect()
    assert sorted((r.row, r.section, r.path) for r in rows) == [
        (8, "A", "土地"), (9, "A", "土地/山"), (10, "A", "土地/畑"), (11, "A", "土地/畑/茶"), (12, "A", "合計"), (13, "A", "別"), (22, "B", "給与"),
    ]


def test_values_reasons_and_places(spark):
    cells = HEADS + BODY + [("s", 8, 7, "1,234"), ("s", 8, 8, "-"), ("s", 9, 10, "2.5"), ("s", 9, 9, "-3"), ("s", 24, 7, "9"), ("s", 14, 2, "土地"), ("s", 8, 9, "")]
    out = sorted((r.path, r.code, r.sub, r.value, r.place, r.reason) for r in lo.statement_values(frame(spark, cells), LAYOUT).collect() if r.code)
    assert out == [("土地/山", "S", "一般", -3, "I9", None), ("土地/山", "S", "全体", None, "J9", "not_integer")]
    assert [(r.path, r.reason) for r in lo.statement_values(frame(spark, cells), LAYOUT).collect() if r.code is None] == [("土地", "duplicate_path")]


def test_defects_of_a_sheet(spark):
    assert defects(spark, HEADS + BODY) == []
    assert defects(spark, [h for h in HEADS if h[1] != 21] + BODY) == [("heads_differ", 4, "G,H,I,J"), ("no_heads", 4, "G,H,I,J")]
    assert defects(spark, [("s", 4, 7, "西") if h[1:3] == (4, 7) else h for h in HEADS] + BODY) == [("unknown_group", 2, "G,H")]
    assert defects(spark, [h for h in HEADS if h[1:3] != (4, 9)] + BODY) == [("repeated", 4, "G,H,I,J")]
    odd = [(*h[:3], "その他") if h[2] == 8 and h[1] > 4 else h for h in HEADS]
    assert defects(spark, odd + BODY) == [("unknown_sub", 1, "H")]
    assert lo.statement_values(frame(spark, odd + BODY + [("s", 8, 7, "1")]), LAYOUT).count() == 0


def test_empty_cells(spark):
    none = frame(spark, [])
    assert lo.statement_values(none, LAYOUT).count() == 0
    assert lo.year_rows(none, 3).count() == lo.year_blocks(none, 3).count() == lo.region_sheet(none, {"北": "N"}).count() == 0


def test_eras_are_carried(spark):
    rows = [("s", 7, 2, "9"), ("s", 7, 5, "1"), ("s", 8, 1, "平成"), ("s", 8, 2, "３１"), ("s", 9, 2, "31年度"), ("s", 9, 5, "2"), ("s", 10, 1, "令 和"), ("s", 10, 2, "元"), ("s", 10, 5, "3"), ("s", 11, 2, "2"), ("s", 11, 5, "－"), ("t", 9, 2, "5"), ("t", 9, 5, "4")]
    assert sorted((r.period, r.value) for r in lo.year_rows(frame(spark, rows), 5).collect()) == [("FY2019", 2), ("FY2019", 3)]
    blocks = [("s", 1, 1, "昭和"), ("s", 2, 1, "63年"), ("s", 3, 2, "計"), ("s", 3, 4, "5"), ("s", 4, 2, "小計"), ("s", 4, 4, "6"), ("s", 5, 1, "平成"), ("s", 6, 2, "計"), ("s", 6, 4, "7"), ("s", 7, 1, "元"), ("s", 8, 2, "計"), ("s", 8, 4, "8")]
    assert sorted((r.period, r.row, r.value) for r in lo.year_blocks(frame(spark, blocks), 4).collect()) == [("FY1988", 3, 5), ("FY1988", 6, 7), ("FY1989", 8, 8)]


def test_a_year_before_any_era_is_an_error(spark):
    cells = frame(spark, [("s", 1, 2, "63"), ("s", 1, 3, "平成元年度"), ("s", 2, 1, "歳入"), ("s", 2, 3, "4")])
    out = lo.year_columns(cells, frame(spark, [("s", "歳入", 0)], "sheet string, label string, occurrence int"), 1).collect()
    assert [(r.period, r.reason) for r in out] == [(None, "no_era")]


def test_totals_below_a_section_stop_at_the_next(spark):
    cells = [("b!R6", 2, 6, "決算額"), ("b!R6", 10, 2, "防衛費"), ("b!R6", 11, 3, "小計"), ("b!R6", 11, 6, "1"), ("b!R6", 12, 3, "（合計）"), ("b!R6", 12, 6, "2"), ("b!R6", 13, 2, "国債費"), ("b!R6", 14, 3, "計"), ("b!R6", 14, 6, "3"), ("note", 2, 6, "決算額")]
    out = lo.year_sheets(frame(spark, cells), frame(spark, [("防衛費", "決算額"), ("国債費", "決算額")], "section string, head string")).collect()
    assert sorted((r.section, r.period, r.row, r.value) for r in out) == [("国債費", "FY2024", 14, 3), ("防衛費", "FY2024", 12, 2)]


def test_two_levels_must_name_one_column(spark):
    cells = [("s", 2, 2, "道路"), ("s", 3, 2, "粗"), ("s", 3, 3, "純"), ("s", 2, 4, "港"), ("s", 3, 4, "粗"), ("s", 3, 5, "粗"), ("s", 5, 1, "2001"), ("s", 5, 3, "1.5"), ("s", 5, 4, "2"), ("s", 6, 1, "計"), ("s", 6, 3, "9")]
    out = lo.two_level(frame(spark, cells), frame(spark, [("s", "道路", "純"), ("s", "港", "粗")], "sheet string, group string, sub string")).collect()
    assert sorted((r.group, r.period, r.place, r.reason) for r in out) == sorted([("道路", "FY2001", "C5", None), ("港", None, None, "columns")], key=str)


def test_regions_stand_once_each(spark):
    codes = {"全国": "JP", "東": "E"}
    good = [("s", 3, 1, "年度"), ("s", 3, 2, "2001"), ("s", 4, 1, "全 国"), ("s", 4, 2, "5"), ("s", 5, 1, "東"), ("s", 5, 2, "x")]
    see = lambda rows: [(r.code, r.period, r.reason) for r in lo.region_sheet(frame(spark, rows), codes).collect()]
    assert see(good) == [("JP", "FY2001", None)]
    assert see(good + [("s", 6, 1, "東")]) == [(None, None, "repeated_region")]
    assert see(good[:4]) == [(None, None, "missing_region")]
    assert see(good[1:]) == [(None, None, "no_years")]


def test_tasks_grow_with_the_tables(spark, monkeypatch):
    """Orders and cells are dealt by sheet to as many tasks as their rows call for, and a sheet stays in one of them."""
    from pyspark.sql import functions as F

    from quillstone.plans import layout_queries as lq
    from quillstone.sources import shared

    monkeypatch.setattr(lq, "ORDERS", 50)
    orders = lq._orders(spark, "/root/testdata/sf0.001")
    assert orders.rdd.getNumPartitions() == -(-orders.count() // 50) > 8
    cells = shared.dealt(frame(spark, [(f"s{i % 9}", i, 1, "x") for i in range(100)]), "sheet", each=5)
    assert cells.rdd.getNumPartitions() == 20
    assert cells.withColumn("task", F.spark_partition_id()).groupBy("sheet").agg(F.count_distinct("task").alias("n")).filter("n > 1").isEmpty()


def test_facts_are_summed_in_tasks_that_grow_with_the_lines(spark, monkeypatch):
    from quillstone.plans import adapters

    monkeypatch.setattr(adapters, "tasks_for", lambda rows: -(-rows.count() // 300))
    facts = adapters.facts(spark, "/root/testdata/sf0.001", "o_custkey")
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3 and plan.count("ENSURE_REQUIREMENTS") == 0
