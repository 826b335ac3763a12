"""Tables by layout: paths from indentation, headers of two levels, fiscal years of eras. All read cells (sheet, row, col, text).

Rows and columns count from 1. A sheet's rows are followed in order by windows over its own rows, so that a sheet is as
large as one file is; cells meet rows and columns by equal keys, whatever sheet holds the most of them. What cannot be
settled is a reason beside the place, never the first match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.periods import ERAS, era_fiscal
from quillstone.functions.text import column_letters, is_number

# Labels of total rows, of a head above the labels, and of what ends the statements of a sheet.
TOTALS, HEAD, END = ("計", "合計"), "科目", "指標"
#: Fixed value: a year's head in a row of them; marked ones (forecasts, budgets) are no years.
YEAR_HEAD = "^(昭和|平成|令和)?([0-9]{1,2}|元)(年度)?$"
WHOLE_ERAS = {era: base for era, base in ERAS.items() if len(era) > 1}


@dataclass(frozen=True)
class Statements:
    """sections: the word in column 1 that opens each, and its name; groups: printed names of column groups and codes."""

    sections: tuple[tuple[str, str], ...]
    groups: dict[str, str]
    subs: tuple[str, ...]
    depth: int = 6
    group_row: int = 4
    head_columns: int = 3  # a section's row of heads has the first of subs within so many columns behind the labels


def norm(text: Column) -> Column:
    """Without white space; a blank cell is none."""
    t = F.regexp_replace(text, r"(?U)\s", "")
    return F.when(t != "", t)


def place(row: Column, col: Column) -> Column:
    """A1, as spreadsheets name it."""
    return F.concat(column_letters(col - 1), row.cast("string"))


def _mapped(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _running(*order: str):
    return Window.partitionBy("sheet").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def statement_rows(cells: DataFrame, layout: Statements) -> DataFrame:
    """sheet, row, section, path, heads: each labelled row's path, and the rows of column heads (path null).

    The level of a label is its column. The path of a row has, for each column to the left, the last label that no label
    further left, total or section followed. A label in column 1 is a total: its path is itself, and it ends all paths.
    Rows after the end mark, before a section, and heads of labels are left out.
    """
    text = norm(F.col("text"))
    inside = F.col("col") <= layout.depth
    behind = F.col("col").between(layout.depth + 1, layout.depth + layout.head_columns)
    rows = cells.select("sheet", "row", "col", text.alias("text")).filter("text IS NOT NULL").groupBy("sheet", "row").agg(
        F.max_by(F.when(inside, F.col("text")), F.when(inside, F.col("col"))).alias("label"), F.max(F.when(inside, F.col("col"))).alias("level"),
        F.max(F.when(F.col("col") == 1, F.col("text"))).alias("first"), F.coalesce(F.bool_or(behind & (F.col("text") == layout.subs[0])), F.lit(False)).alias("heads"),
    )
    mark = F.coalesce(*(F.when(F.contains("first", F.lit(word)), F.lit(name)) for word, name in layout.sections))
    w = _running("row")
    rows = rows.withColumn("mark", mark)
    rows = rows.withColumns({"section": F.last("mark", ignorenulls=True).over(w), "ended": F.coalesce(F.bool_or((F.col("first") == END) & F.col("mark").isNull()).over(w), F.lit(False))})
    body = ~F.col("ended") & F.col("mark").isNull() & F.col("section").isNotNull() & (F.coalesce("label", F.lit("")) != HEAD)
    rows = rows.withColumn("level", F.when(body, F.col("level"))).withColumn("cut", F.col("mark").isNotNull() | F.coalesce(F.col("level") == 1, F.lit(False)))
    above = {}
    for k in range(2, layout.depth):
        above[f"at{k}"] = F.last(F.when(F.col("level") == k, F.struct("row", "label")), ignorenulls=True).over(w)
        above[f"cut{k}"] = F.coalesce(F.max(F.when(F.col("cut") | (F.col("level") < k), F.col("row"))).over(w), F.lit(0))
    rows = rows.withColumns(above).filter(body)
    parents = (F.when((F.col("level") > k) & (F.col(f"at{k}.row") > F.col(f"cut{k}")), F.col(f"at{k}.label")) for k in range(2, layout.depth))
    path = F.when(F.col("level") == 1, F.col("label")).when(F.col("level") > 1, F.concat_ws("/", *parents, "label"))
    return rows.select("sheet", "row", "section", path.alias("path"), (F.col("heads") & F.col("label").isNull()).alias("heads")).filter("path IS NOT NULL OR heads")


def statement_columns(cells: DataFrame, rows: DataFrame, layout: Statements) -> DataFrame:
    """sheet, col, group, code, sub, defects: each column's two heads; the group's name is carried to the right.

    defects: no_heads (a section has no row of heads; at each column), unknown_group, unknown_sub, heads_differ (another
    section has something else there) and repeated (two columns have the same heads).
    """
    names = [name for _, name in layout.sections]
    first = rows.filter("heads").groupBy("sheet", "section").agg(F.min("row").alias("row"))
    named = cells.filter(F.col("col") > layout.depth).select("sheet", "row", "col", norm(F.col("text")).alias("text")).filter("text IS NOT NULL")
    subs = named.join(first, ["sheet", "row"]).select("sheet", "col", "section", "text")
    groups = named.filter(F.col("row") == layout.group_row).select("sheet", "col", F.lit("").alias("section"), "text")
    at = lambda s: F.max(F.when(F.col("section") == s, F.col("text")))
    wide = subs.union(groups).groupBy("sheet", "col").agg(at("").alias("name"), *(at(n).alias(f"s{i}") for i, n in enumerate(names)))
    some = F.count("s0").over(Window.partitionBy("sheet"))
    wide = wide.withColumns({"group": F.last("name", ignorenulls=True).over(_running("col")), **{f"has{i}": F.max(F.col(f"s{i}").isNotNull()).over(Window.partitionBy("sheet")) for i in range(len(names))}, "some": some})
    wide = wide.withColumns({"code": _mapped(layout.groups, F.col("group")), "sub": F.col("s0")}).filter("s0 IS NOT NULL OR (name IS NOT NULL AND (some = 0 OR code IS NULL))")
    same = F.count("*").over(Window.partitionBy("sheet", "group", "sub"))
    defects = F.array(
        F.when(~F.forall(F.array(*(f"has{i}" for i in range(len(names)))), lambda h: h), "no_heads"), F.when(F.col("code").isNull(), "unknown_group"),
        F.when(F.col("sub").isNotNull() & ~F.col("sub").isin(*layout.subs), "unknown_sub"),
        F.when(~F.forall(F.array(*(f"s{i}" for i in range(1, len(names)))), lambda s: s.eqNullSafe(F.col("s0"))) if len(names) > 1 else F.lit(False), "heads_differ"), F.when(same > 1, "repeated"),
    )
    return wide.select("sheet", "col", "group", "code", "sub", F.filter(defects, lambda d: d.isNotNull()).alias("defects"))


def sheet_defects(columns: DataFrame) -> DataFrame:
    """sheet, defect, n, places: a sheet with any of them gives no values; places names five columns at most."""
    each = columns.select("sheet", "col", F.explode("defects").alias("defect"))
    first = F.row_number().over(Window.partitionBy("sheet", "defect").orderBy("col"))
    return each.withColumn("_n", first).groupBy("sheet", "defect").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.struct("col", column_letters(F.col("col") - 1).alias("name")))))["name"], ",").alias("places"))


def statement_values(cells: DataFrame, layout: Statements) -> DataFrame:
    """sheet, section, path, code, sub, value, place, reason over the sheets without a defect.

    A dash or blank is no value. A figure that is no whole number is not_integer, with its text as place's note; a path
    that stands in two rows is duplicate_path once, without a value: asking for it is an error, other rows stay usable.
    """
    cells = cells.select("sheet", "row", "col", "text")
    rows = statement_rows(cells, layout)
    columns = statement_columns(cells, rows, layout)
    bad = columns.filter(F.size("defects") > 0).select("sheet").distinct()
    good = rows.filter("path IS NOT NULL").groupBy("sheet", "section", "path").agg(F.count("*").alias("n"), F.min("row").alias("row")).join(bad, "sheet", "left_anti")
    number = F.regexp_replace(F.trim("text"), ",", "")
    figures = cells.filter(F.col("col") > layout.depth).withColumn("number", number).filter(is_number(F.col("number"))).withColumn("number", F.col("number").try_cast("decimal(38,6)"))
    whole = F.col("number") == F.floor("number")
    values = figures.join(good.filter("n = 1").drop("n"), ["sheet", "row"]).join(columns.filter("sub IS NOT NULL AND code IS NOT NULL").select("sheet", "col", "code", "sub"), ["sheet", "col"])
    values = values.select("sheet", "section", "path", "code", "sub", F.when(whole, F.col("number").cast("decimal(30,0)")).alias("value"), place(F.col("row"), F.col("col")).alias("place"), F.when(~whole, "not_integer").alias("reason"))
    none = F.lit(None).cast("string")
    twice = good.filter("n > 1").select("sheet", "section", "path", none.alias("code"), none.alias("sub"), F.lit(None).cast("decimal(30,0)").alias("value"), none.alias("place"), F.lit("duplicate_path").alias("reason"))
    return values.unionByName(twice)


# --- fiscal years of eras


def year_number(text: Column) -> Column:
    """The number of a bare year such as 元, 3年 or 12年度."""
    t = F.regexp_replace(norm(text), "年度?", "")
    return F.when(t == "元", 1).when(t.rlike("^[0-9]{1,2}$"), t.cast("int"))


def figure(text: Column) -> Column:
    """The number in a cell as a decimal; dashes and texts are none."""
    t = F.regexp_replace(F.trim(text), ",", "")
    return F.when(is_number(t), t.try_cast("decimal(38,6)"))


def _by_row(cells: DataFrame, value_col: int) -> DataFrame:
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    some = cells.filter(F.col("col").isin(1, 2, value_col))
    return some.groupBy("sheet", "row").agg(norm(at(1)).alias("a"), norm(at(2)).alias("b"), figure(at(value_col)).alias("value"))


def _fiscal(base: Column, number: Column) -> Column:
    return F.concat(F.lit("FY"), (base + number).cast("string"))


def year_rows(cells: DataFrame, value_col: int, first_row: int = 7) -> DataFrame:
    """sheet, period, row, value: the era stands in column 1 where it begins, the year's number in column 2."""
    rows = _by_row(cells, value_col).filter(F.col("row") >= first_row).withColumn("era", F.last(_mapped(WHOLE_ERAS, F.col("a")), ignorenulls=True).over(_running("row")))
    return rows.select("sheet", _fiscal(F.col("era"), year_number(F.col("b"))).alias("period"), "row", "value").filter("period IS NOT NULL AND value IS NOT NULL")


def year_blocks(cells: DataFrame, value_col: int) -> DataFrame:
    """sheet, period, row, value: under an era and a year alone in column 1, the row whose column 2 says 計."""
    w = _running("row")
    rows = _by_row(cells, value_col).withColumn("era", F.last(_mapped(WHOLE_ERAS, F.col("a")), ignorenulls=True).over(w))
    head = _fiscal(F.col("era"), year_number(F.col("a")))
    rows = rows.withColumn("head", head).withColumn("period", F.last("head", ignorenulls=True).over(w))
    return rows.filter((F.col("b") == TOTALS[0]) & F.col("head").isNull() & _mapped(WHOLE_ERAS, F.coalesce("a", F.lit(""))).isNull()).select("sheet", "period", "row", "value").filter("period IS NOT NULL AND value IS NOT NULL")


def year_columns(cells: DataFrame, asked: DataFrame, header_row: int) -> DataFrame:
    """sheet, label, occurrence, period, col, value, reason for asked (sheet, label, occurrence; 0: the only one).

    Years stand in one row, their era carried to the right; a marked head (a forecast, a budget) is no year. A label
    that stands in several rows is several_rows, in none no_row, a year before any era no_era.
    """
    heads = cells.filter(F.col("row") == header_row).select("sheet", "col", norm(F.col("text")).alias("text")).filter(F.col("text").rlike(YEAR_HEAD))
    part = lambda i: F.regexp_extract("text", YEAR_HEAD, i)
    heads = heads.withColumn("era", F.last(_mapped(WHOLE_ERAS, part(1)), ignorenulls=True).over(_running("col")))
    heads = heads.select("sheet", "col", _fiscal(F.col("era"), year_number(part(2))).alias("period"))
    unset = heads.filter("period IS NULL").select("sheet").distinct().withColumn("no_era", F.lit(True))
    labels = cells.filter((F.col("row") > header_row) & (F.col("col") <= 4)).select("sheet", "row", norm(F.col("text")).alias("label")).filter("label IS NOT NULL").distinct()
    wanted = asked.select("sheet", norm(F.col("label")).alias("label"), F.coalesce("occurrence", F.lit(0)).alias("occurrence")).distinct()
    w = Window.partitionBy("sheet", "label")
    labels = labels.join(wanted.select("sheet", "label").distinct(), ["sheet", "label"], "left_semi").withColumns({"nth": F.row_number().over(w.orderBy("row")), "n": F.count("*").over(w)})
    hit = wanted.join(labels, ["sheet", "label"], "left").groupBy("sheet", "label", "occurrence").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max(F.when(F.col("nth") == F.greatest("occurrence", F.lit(1)), F.col("row"))).alias("row"))
    reason = F.when(F.col("no_era"), "no_era").when(F.col("row").isNull(), "no_row").when((F.col("occurrence") == 0) & (F.col("n") > 1), "several_rows")
    hit = hit.join(unset, "sheet", "left").select("sheet", "label", "occurrence", "row", reason.alias("reason"))
    values = cells.select("sheet", "row", "col", figure(F.col("text")).alias("value")).filter("value IS NOT NULL").join(hit.filter("reason IS NULL"), ["sheet", "row"]).join(heads, ["sheet", "col"])
    out = values.select("sheet", "label", "occurrence", "period", "col", "value", "reason")
    lost = hit.filter("reason IS NOT NULL").select("sheet", "label", "occurrence", F.lit(None).cast("string").alias("period"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("decimal(38,6)").alias("value"), "reason")
    return out.unionByName(lost)


def year_sheets(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """sheet, section, head, period, row, value, reason: a sheet a year, a row a section; asked has section and head.

    A sheet is named by its year, behind the book's name and "!" where there are several books.

    The head must stand in one column of the first 8 rows (else head_columns), the section in one row of columns 2 or 3,
    brackets aside (several_rows; in none: no row comes out). A row with figures elsewhere is complete, and has none in
    this column. A row of a label alone takes the only total below it, before the next section asked for (else totals).
    """
    base = cells.select("sheet", "row", "col", "text").withColumn("period", era_fiscal(F.substring_index("sheet", "!", -1), False)).filter("period IS NOT NULL")
    wanted = asked.select(norm(F.col("section")).alias("section"), norm(F.col("head")).alias("head")).distinct()
    cols = base.filter("row <= 8").select("sheet", "col", norm(F.col("text")).alias("head")).distinct().join(wanted.select("head").distinct(), "head").groupBy("sheet", "head").agg(F.count("*").alias("n_cols"), F.min("col").alias("col"))
    at = lambda c: F.max(F.when(F.col("col") == c, norm(F.col("text"))))
    rows = base.groupBy("sheet", "row").agg(F.coalesce(at(2), at(3)).alias("label"), F.coalesce(F.bool_or((F.col("col") >= 4) & (F.col("text") != "")), F.lit(False)).alias("full"), F.first("period").alias("period"))
    rows = rows.withColumn("label", F.regexp_replace("label", "^[（()）]+|[（()）]+$", "")).filter("label IS NOT NULL")
    known = wanted.select(F.col("section").alias("label"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, "label", "left")
    # totals belong to the last section above them
    total = F.col("label").isin(*TOTALS)
    spans = rows.withColumn("open", F.last(F.when(F.col("known"), F.col("row")), ignorenulls=True).over(_running("row")))
    below = spans.filter(total & F.col("known").isNull()).groupBy("sheet", F.col("open").alias("row")).agg(F.count("*").alias("n_totals"), F.min("row").alias("total_row"))
    hits = rows.filter("known").join(below, ["sheet", "row"], "left")
    hits = hits.groupBy("sheet", F.col("label").alias("section")).agg(F.count("*").alias("n_rows"), F.min("row").alias("row"), F.first("period").alias("period"), F.bool_or("full").alias("full"), F.coalesce(F.first("n_totals"), F.lit(0)).alias("n_totals"), F.first("total_row").alias("total_row"))
    each = hits.join(wanted, "section").join(cols, ["sheet", "head"], "left")
    reason = F.when(F.coalesce("n_cols", F.lit(0)) != 1, "head_columns").when(F.col("n_rows") > 1, "several_rows").when(~F.col("full") & (F.col("n_totals") != 1), "totals")
    each = each.withColumn("reason", reason).withColumn("row", F.when(F.col("reason").isNull(), F.when(F.col("full"), F.col("row")).otherwise(F.col("total_row"))))
    values = base.select("sheet", "row", "col", figure(F.col("text")).alias("value")).filter("value IS NOT NULL")
    return each.join(values, ["sheet", "row", "col"], "left").filter("reason IS NOT NULL OR value IS NOT NULL").select("sheet", "section", "head", "period", "row", "value", "reason")


# --- headers of two levels


def two_level(cells: DataFrame, asked: DataFrame, group_row: int = 2, sub_row: int = 3, first_row: int = 5) -> DataFrame:
    """sheet, group, sub, period, value, place, reason for asked (sheet, group, sub): the group's name is carried to the right.

    Not exactly one column with both names is columns; rows are whole years in column 1, others are passed by.
    """
    heads = cells.filter(F.col("row").isin(group_row, sub_row) & (F.col("col") > 1)).groupBy("sheet", "col").agg(norm(F.max(F.when(F.col("row") == group_row, F.col("text")))).alias("g"), norm(F.max(F.when(F.col("row") == sub_row, F.col("text")))).alias("sub"))
    heads = heads.withColumn("group", F.last("g", ignorenulls=True).over(_running("col"))).filter("sub IS NOT NULL")
    wanted = asked.select("sheet", norm(F.col("group")).alias("group"), norm(F.col("sub")).alias("sub")).distinct()
    cols = wanted.join(heads.groupBy("sheet", "group", "sub").agg(F.count("*").alias("n"), F.min("col").alias("col")), ["sheet", "group", "sub"], "left")
    cols = cols.withColumn("reason", F.when(F.coalesce("n", F.lit(0)) != 1, "columns"))
    years = cells.filter((F.col("col") == 1) & (F.col("row") >= first_row) & F.trim("text").rlike("^[0-9]{4}$")).select("sheet", "row", F.concat(F.lit("FY"), F.trim("text")).alias("period"))
    values = cells.select("sheet", "row", "col", figure(F.col("text")).alias("value")).filter("value IS NOT NULL").join(cols.filter("reason IS NULL").drop("n"), ["sheet", "col"]).join(years, ["sheet", "row"])
    out = values.select("sheet", "group", "sub", "period", "value", place(F.col("row"), F.col("col")).alias("place"), "reason")
    return out.unionByName(cols.filter("reason IS NOT NULL").select("sheet", "group", "sub", F.lit(None).cast("string").alias("period"), F.lit(None).cast("decimal(38,6)").alias("value"), F.lit(None).cast("string").alias("place"), "reason"))


def region_sheet(cells: DataFrame, regions: dict[str, str], header_row: int = 3) -> DataFrame:
    """sheet, code, period, value, place, reason: a row a region, a column a year, and defects of a whole sheet.

    The header says 年度 in column 1 and has years, else no_years; every region stands in one row, else repeated_region
    or missing_region. A sheet with a reason has one row for it and no values.
    """
    cells = cells.select("sheet", "row", "col", norm(F.col("text")).alias("text")).filter("text IS NOT NULL")
    years = cells.filter((F.col("row") == header_row) & (F.col("col") > 1) & F.col("text").rlike("^[0-9]{4}$")).select("sheet", "col", F.concat(F.lit("FY"), "text").alias("period"))
    rows = cells.filter((F.col("row") > header_row) & (F.col("col") == 1)).select("sheet", "row", _mapped(regions, F.col("text")).alias("code")).filter("code IS NOT NULL")
    found = rows.groupBy("sheet").agg(F.count("*").alias("n"), F.count_distinct("code").alias("k"))
    heads = years.groupBy("sheet").agg(F.count("*").alias("years"))
    titles = cells.groupBy("sheet").agg(F.bool_or((F.col("row") == header_row) & (F.col("col") == 1) & (F.col("text") == "年度")).alias("titled"))
    reason = F.when(~F.col("titled") | F.col("years").isNull(), "no_years").when(F.col("n") > F.col("k"), "repeated_region").when(F.coalesce("k", F.lit(0)) < len(set(regions.values())), "missing_region")
    state = titles.join(found, "sheet", "left").join(heads, "sheet", "left").select("sheet", reason.alias("reason"))
    values = cells.select("sheet", "row", "col", figure(F.col("text")).alias("value")).filter("value IS NOT NULL").join(rows, ["sheet", "row"]).join(years, ["sheet", "col"]).join(state.filter("reason IS NULL"), "sheet")
    none = lambda t: F.lit(None).cast(t)
    return values.select("sheet", "code", "period", "value", place(F.col("row"), F.col("col")).alias("place"), "reason").unionByName(
        state.filter("reason IS NOT NULL").select("sheet", none("string").alias("code"), none("string").alias("period"), none("decimal(38,6)").alias("value"), none("string").alias("place"), "reason"))
