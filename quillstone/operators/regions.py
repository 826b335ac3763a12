"""Tables by region as filings print them: merged cells laid on a grid, labels paired with values, and the ratio abroad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.periods import months_between

#: Content of a section: paragraphs and tables in order; a cell may span rows and columns and hold tables of its own.
CONTENT = "array<struct<type:string,text:string,rows:array<array<struct<text:string,rowspan:int,colspan:int,tables:int>>>>>"

# Labels of home and total cells, marks of notes, statements instead of a table, units of figures.
HOME = r"^(日本|本邦|国内|日本国内)([（(][^）)]*[）)])?$"
TOTAL = r"^(合計|計|総計|連結|連結合計|連結計|合計額|売上収益|売上高|連結売上高|連結売上収益|外部顧客への売上高|外部顧客への売上収益)([（(][^）)]*[）)])?$"
NOTE_MARK = r"[（(]?注[）)]?\d*|※\d*|\*\d*|[（(]\d[）)]$"
UNIT_ONLY = r"^[（(]?単位[:：][^）)]*[）)]?$"
NONE_OUTSIDE = r"本邦以外.{0,30}(ない|無い|ありません|存在しない|該当事項はありません)|(すべて|全て|全額)本邦|本邦のみ"
OVER_90 = r"(90|９０)\s*[%％]"
UNITS = (10**6, 10**3, 1)
IFRS_SECTION, SECTION = "geographic_areas_ifrs", "revenue"

#: Sections of one document, basis, kind, context and period are one.
KEYS = ["company", "doc", "basis", "section", "context", "period"]
NUMBER = "decimal(30,0)"
_VALUE = f"struct<row:int,col:int,source:int,text:string,kind:string,number:{NUMBER}>"
PAIRS = f"array<struct<table:int,pair:struct<at:int,total_at:int,home:{_VALUE},total:{_VALUE},unit:bigint>>>"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def is_filler(text: Column) -> Column:
    """Blank, a unit alone, or a sentence: no label and no value."""
    s = squeezed(text)
    return (s == "") | F.contains(s, F.lit("。")) | s.rlike(UNIT_ONLY)


def is_value_table(rows: Column) -> Column:
    """Some cell is a label or value; a statement set in a frame is no table."""
    return F.exists(F.flatten(rows), lambda cell: ~is_filler(cell.text))


def label_of(text: Column) -> Column:
    """A label without white space and marks of notes."""
    return F.regexp_replace(squeezed(text), f"(?U){NOTE_MARK}", "")


def number_of(text: Column) -> Column:
    """A whole number, with separators at thousands or without, and perhaps a unit behind it; else null."""
    s = F.translate(squeezed(text), "，０１２３４５６７８９", ",0123456789")
    s = F.regexp_replace(s, "(百万円|千円|円)$", "")
    return F.when(s.rlike(r"^(\d{1,3}(,\d{3})+|\d+)$"), F.regexp_replace(s, ",", "").try_cast(NUMBER))


def grid(rows: Column) -> Column:
    """The cells of a table by position: array of (row, col, source, text), a merged cell at each place that it covers.

    Cells take the free places of their row from left to right; a place is taken while a cell above reaches down to it.
    source is the cell's number in the table, so that two places of one cell can be told from two cells. A span below 1
    counts as 1; a cell that reaches below the last row is cut there.
    """
    place = "struct<row:int,col:int,source:int,text:string>"

    def put(state, cell):
        width, height = F.greatest(F.coalesce(cell.colspan, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(cell.rowspan, F.lit(1)), F.lit(1))
        # the first place from here on that no cell above takes; busy ends in a free place
        free = F.filter(F.sequence(state.col, F.greatest(F.size(state.busy), state.col)), lambda c: F.coalesce(F.get(state.busy, c), F.lit(0)) == 0)[0]
        last = free + width - 1
        columns = F.sequence(F.lit(0), F.greatest(F.size(state.busy) - 1, last))
        busy = F.transform(columns, lambda c: F.when(c.between(free, last), height).otherwise(F.coalesce(F.get(state.busy, c), F.lit(0))))
        new = F.transform(F.sequence(free, last), lambda c: F.struct(state.row.alias("row"), c.alias("col"), state.source.alias("source"), height.alias("height"), cell.text.alias("text")))
        return F.struct(state.row.alias("row"), (last + 1).alias("col"), (state.source + 1).alias("source"), busy.alias("busy"), F.concat(state.cells, new).alias("cells"))

    def line(state, cells):
        begun = F.struct(state.row.alias("row"), F.lit(0).alias("col"), state.source.alias("source"), state.busy.alias("busy"), state.cells.alias("cells"))
        done = F.aggregate(cells, begun, put)
        below = lambda s: F.transform(s.busy, lambda n: F.greatest(n - 1, F.lit(0)))
        return F.transform(F.array(done), lambda s: F.struct((s.row + 1).alias("row"), F.lit(0).alias("col"), s.source.alias("source"), below(s).alias("busy"), s.cells.alias("cells")))[0]

    empty = F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("source"), F.array().cast("array<int>").alias("busy"), F.array().cast("array<struct<row:int,col:int,source:int,height:int,text:string>>").alias("cells"))
    cells = F.aggregate(rows, empty, line, lambda s: s.cells)
    down = F.transform(cells, lambda x: F.transform(F.sequence(x.row, F.least(x.row + x.height, F.size(rows)) - 1), lambda r: F.struct(r.alias("row"), x.col.alias("col"), x.source.alias("source"), x.text.alias("text"))))
    return F.flatten(down).cast(f"array<{place}>")


def value_tables(content: Column) -> Column:
    return F.filter(content, lambda x: (x.type == "table") & is_value_table(x.rows))


def places(rows: Column) -> Column:
    """grid with the kind of each cell's label (home, total or null) and its number, if it is one."""

    def told(x):
        kind = F.transform(F.array(label_of(x.text)), lambda t: F.when(t.rlike(HOME), "home").when(t.rlike(TOTAL), "total"))[0]
        return F.struct(x.row.alias("row"), x.col.alias("col"), x.source.alias("source"), x.text.alias("text"), kind.alias("kind"), number_of(x.text).alias("number"))

    return F.transform(grid(rows), told)


def cell_pairs(cells: Column, tagged: Column) -> Column:
    """Pairs (home, total, unit) of values under, or right of, a home and a total label, whose total is the tagged figure.

    Both values stand in one row below their labels, which are in different columns, or in one column right of their
    labels, which are in different rows; they are numbers of different cells. The total times one of UNITS, the largest
    first, must be the tagged figure to less than a unit. That is asked of the few totals first, so that no value is
    compared with all others.
    """
    unit = lambda n: F.coalesce(*(F.when((n > 0) & (F.abs(n * u - tagged) < u), u) for u in UNITS)).cast("long")
    found = F.struct(F.filter(cells, lambda x: x.kind == "home").alias("homes"), F.filter(cells, lambda x: x.kind == "total").alias("totals"), F.filter(cells, lambda x: x.number.isNotNull()).alias("values"), F.filter(cells, lambda x: unit(x.number).isNotNull()).alias("hits"))

    def under(x, label, line: str, across: str):
        return (x[across] == label[across]) & (x[line] > label[line])

    def along(c, line: str, across: str):
        """line: what both values share; across: in which their labels differ."""

        def of_total(mark):
            def of_hit(hit):
                homes = F.filter(c.homes, lambda h: (h[across] != mark[across]) & (hit[line] > h[line]))
                values = lambda h: F.filter(c["values"], lambda v: (v[line] == hit[line]) & (v[across] == h[across]) & (v.source != hit.source))
                return F.flatten(F.transform(homes, lambda h: F.transform(values(h), lambda v: F.struct(v.source.alias("at"), hit.source.alias("total_at"), v.alias("home"), hit.alias("total"), unit(hit.number).alias("unit")))))

            return F.flatten(F.transform(F.filter(c.hits, lambda hit: under(hit, mark, line, across)), of_hit))

        return F.flatten(F.transform(c.totals, of_total))

    return F.transform(F.array(found), lambda c: F.concat(along(c, "row", "col"), along(c, "col", "row")))[0]


def with_texts(sections: DataFrame) -> DataFrame:
    """sections with has_table, quote (all its text, for sections without a value table), home_seen and notes."""
    table_text = F.transform(F.filter("content", lambda x: x.type == "table"), lambda x: F.array_join(F.transform(F.flatten(x.rows), lambda c: c.text), " "))
    own_text = F.transform(F.filter("content", lambda x: x.type == "text"), lambda x: x.text)
    tables = value_tables(F.col("content"))
    seen = F.exists(tables, lambda x: F.exists(F.flatten(x.rows), lambda c: label_of(c.text).rlike(HOME)))
    notes = F.slice(F.filter(own_text, lambda x: x.rlike("基礎|分類|所在|仕向")), 1, 3)
    return sections.withColumn("has_table", F.size(tables) > 0).withColumn("quote", F.trim(F.concat_ws(" ", F.array_join(own_text, " "), F.array_join(table_text, " ")))).withColumn("home_seen", seen).withColumn("notes", notes)


def chosen_sections(requests: DataFrame, sections: DataFrame, trend: bool) -> DataFrame:
    """requests (company, doc, basis, period, ifrs, tagged) with the section asked for, null if there is none, and why.

    A screen takes the current section (of the period, unless it is the one section under IFRS). A trend also takes the
    section that a later document has of the period before, and under IFRS the section of the year after. Of several the
    first by context and period is taken.
    """
    own = ["company", "doc", "basis", "period"]
    keyed = sections.withColumnRenamed("period", "of_period")
    want = F.when(F.col("ifrs"), IFRS_SECTION).otherwise(SECTION)
    mine = requests.withColumn("section", want).join(keyed, ["company", "doc", "basis", "section"], "left")
    current = F.startswith(F.col("context"), F.lit("CurrentYear"))
    if trend:
        fits = (F.col("of_period") == F.col("period")) | (F.col("ifrs") & current & (months_between(F.col("period"), F.col("of_period")) == 12))
    else:
        fits = current & ((F.col("of_period") == F.col("period")) | F.col("ifrs"))
    names = [c for c in keyed.columns if c not in ("company", "doc", "basis", "section")]
    best = F.min_by(F.struct(*names), F.when(fits, F.struct("context", "of_period")))
    out = mine.groupBy(*own, "ifrs", "tagged", "section").agg(F.when(F.max(fits), best).alias("found"))
    return out.withColumn("missing", F.when(F.col("found").isNull(), "regions_not_in_document" if trend else "regions_not_tagged"))


def overseas_ratio(requests: DataFrame, sections: DataFrame, trend: bool = False) -> DataFrame:
    """One row a request: value, or reason and why; home_text, total_text, unit, table, statement, quote and notes.

    requests: company, doc, basis, period (YYYY-MM), ifrs and tagged, the document's tagged revenue (null if none).
    sections: KEYS and content. The pair of cells used is proved twice: the total cell in one of UNITS must equal the
    tagged revenue to less than a unit, and all pairs that do so must have the same texts. Reasons, in this order:
    regions_not_tagged (regions_not_in_document in a trend), overseas_statement_only, regions_omitted,
    home_not_in_table, home_or_total_not_identified. Where the company says that nothing is sold abroad, value is 0.
    """
    own = ["company", "doc", "basis", "period"]
    rows = chosen_sections(requests, with_texts(sections), trend).select(*own, "tagged", "missing", "found.*")
    pairs = F.flatten(F.transform(value_tables(F.col("content")), lambda x, i: F.transform(cell_pairs(places(x.rows), F.col("tagged")), lambda p: F.struct(i.alias("table"), p.alias("pair")))))
    # exploding an array of one keeps the pairs a column, found once for all that asks about them
    rows = rows.withColumn("pairs", F.explode(F.array(F.coalesce(pairs, F.array().cast(PAIRS)))))
    texts = F.array_distinct(F.transform("pairs", lambda p: F.struct(p.pair.home.text, p.pair.total.text)))
    out = rows.withColumn("n_pairs", F.size(texts)).withColumn("first", F.get(F.array_sort("pairs"), F.lit(0)))
    out = out.select("*", F.col("first.table").alias("table"), F.col("first.pair.home").alias("home"), F.col("first.pair.total").alias("total"), F.col("first.pair.unit").alias("unit"))
    abroad = ~F.col("has_table") & F.col("quote").rlike(NONE_OUTSIDE)
    n = F.col("n_pairs")
    reason = (
        F.when(F.col("missing").isNotNull(), F.col("missing"))
        .when(abroad, None)
        .when(~F.col("has_table") & F.col("quote").rlike(OVER_90) & F.contains("quote", F.lit("本邦")), "overseas_statement_only")
        .when(~F.col("has_table"), "regions_omitted")
        .when(F.col("tagged").isNull(), "home_or_total_not_identified")
        .when((n == 0) & ~F.col("home_seen"), "home_not_in_table")
        .when(n != 1, "home_or_total_not_identified")
    )
    why = F.when(reason == "home_or_total_not_identified", F.when(F.col("tagged").isNull(), "no tagged revenue").when(n == 0, "no pair of home and total").otherwise(F.concat(n.cast("string"), F.lit(" pairs"))))
    one = reason.isNull() & ~abroad
    ratio = (F.col("total.number") - F.col("home.number")).cast("double") / F.col("total.number").cast("double")
    return out.select(
        *own, F.when(abroad & F.col("missing").isNull(), 0.0).when(one, ratio).alias("value"), reason.alias("reason"), why.alias("why"),
        *(F.when(one, c).alias(a) for c, a in ((F.col("home.text"), "home_text"), (F.col("total.text"), "total_text"), (F.col("unit"), "unit"), (F.col("table"), "table"))),
        F.when(abroad & F.col("missing").isNull(), "none_outside").alias("statement"), F.when(~F.col("has_table"), F.substring("quote", 1, 200)).alias("quote"), F.when(one, F.col("notes")).alias("notes"),
    )


def region_sections(requests: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """For each request (company, basis, period) the sections of the newest document that has any: found, reason, doc, ...

    documents: company, doc, submitted, current and prior (the periods that it covers). A document's section of a period
    is that of the period itself; under IFRS the current one also stands for the period before, read from the table's
    columns (period_in_columns). Reasons: out_of_range (no document covers the period), not_tagged (none of those has a
    section on this basis), omitted (sections, but no value table). other_docs are older documents with a section.
    """
    covering = requests.join(documents, "company", "left").filter(F.col("doc").isNotNull() & ((F.col("period") == F.col("current")) | (F.col("period") == F.col("prior"))))
    parts = with_texts(sections).withColumnRenamed("period", "of_period")
    hit = covering.join(parts, ["company", "doc", "basis"], "left")
    by_column = (F.col("section") == IFRS_SECTION) & F.startswith(F.col("context"), F.lit("CurrentYear")) & (F.col("period") == F.col("prior")) & (F.col("of_period") != F.col("period"))
    fits = F.coalesce((F.col("of_period") == F.col("period")) | by_column, F.lit(False))
    part = F.when(fits, F.struct("section", "context", "of_period", by_column.alias("period_in_columns"), "has_table", "quote"))
    docs = hit.groupBy("company", "basis", "period", "doc", "submitted").agg(F.array_sort(F.collect_list(part)).alias("sections"))
    has = F.size("sections") > 0
    found = docs.groupBy("company", "basis", "period").agg(
        F.max(F.struct("submitted", "doc")).getField("doc").alias("newest"), F.max(F.when(has, F.struct("submitted", "doc", "sections"))).alias("best"),
        F.count_if(has).alias("n_with"),
    )
    out = requests.join(found, ["company", "basis", "period"], "left")
    reason = F.when(F.col("newest").isNull(), "out_of_range").when(F.col("best").isNull(), "not_tagged").when(~F.exists("best.sections", lambda s: s.has_table), "omitted")
    return out.select("company", "basis", "period", reason.isNull().alias("found"), reason.alias("reason"), F.coalesce("best.doc", "newest").alias("doc"), F.col("best.sections").alias("sections"), F.greatest(F.coalesce("n_with", F.lit(0)) - 1, F.lit(0)).alias("other_docs"))


def unfaithful_copies(sections: DataFrame) -> DataFrame:
    """KEYS, why of sections whose copy isn't that of their source: source_tables, tables within cells too, or a cell without text."""
    tables = F.filter("content", lambda x: x.type == "table")
    cells = F.flatten(F.transform(tables, lambda x: F.flatten(x.rows)))
    n = F.size(tables) + F.aggregate(cells, F.lit(0), lambda s, c: s + F.coalesce(c.tables, F.lit(0)))
    why = F.when(n != F.col("source_tables"), F.concat_ws(" of ", n.cast("string"), F.col("source_tables").cast("string"))).when(F.exists(cells, lambda c: c.text.isNull()), "cell without text")
    return sections.withColumn("why", why).filter("why IS NOT NULL").select(*KEYS, "why")
