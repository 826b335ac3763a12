"""Readers of formats that Spark has no reader for: HTML text, anchors and tables, statistics cubes, wide tables, logs."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHORS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())]))
CELLS = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("table", "row", "col")), T.StructField("text", T.StringType())]))
#: Elements whose text is no part of an article.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
VOID = {"meta", "link", "br", "img", "input", "hr", "source", "col", "wbr", "area", "base", "embed", "track"}


class _Text(HTMLParser):
    """Text outside the skipped elements, and inside main or article where a page has one."""

    def __init__(self):
        super().__init__()
        self.skip, self.main, self.all_text, self.main_text = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        self.main += tag in ("main", "article")

    def handle_endtag(self, tag):
        self.skip -= tag in SKIPPED and self.skip > 0
        self.main -= tag in ("main", "article") and self.main > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.all_text.append(data.strip())
            if self.main:
                self.main_text.append(data.strip())


def article_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    return "\n".join(p.main_text or p.all_text)


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.href, self.label = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.label = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.label.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append({"href": self.href, "label": " ".join("".join(self.label).split())})
            self.href = None


class _Tables(HTMLParser):
    """Rows of outermost tables with their spans."""

    def __init__(self):
        super().__init__()
        self.tables, self.depth, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            self.cell = {"text": "", "rows": span(a.get("rowspan"), 65534), "cols": span(a.get("colspan"), 1000)}
            self.tables[-1][-1].append(self.cell)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] = " ".join(f"{self.cell['text']} {data}".split())

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        if tag in ("td", "th"):
            self.cell = None


def span(value: str | None, most: int) -> int:
    """A span as browsers read it: the digits that the attribute begins with, from 1 to most; 1 for anything else."""
    digits = re.match(r"\s*\+?(\d+)", value or "")
    return min(max(int(digits[1][:9]), 1), most) if digits else 1


def table_cells(html: str | None) -> list[dict]:
    """table, row, col, text of every place of the tables' grids, with merged cells repeated; no cell reaches below its table."""
    p = _Tables()
    p.feed(html or "")
    out = []
    for t, rows in enumerate(p.tables):
        grid: dict[tuple[int, int], str] = {}
        for r, cells in enumerate(rows):
            c = 0
            for cell in cells:
                while (r, c) in grid:
                    c += 1
                for i in range(min(cell["rows"], len(rows) - r)):
                    for j in range(cell["cols"]):
                        grid[r + i, c + j] = cell["text"]
        out += [{"table": t, "row": r, "col": c, "text": x} for (r, c), x in sorted(grid.items())]
    return out


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(article_text)


def _anchors_of(html):
    p = _Anchors()
    p.feed(html or "")
    return p.found


@F.pandas_udf(ANCHORS)
def html_anchors(s: pd.Series) -> pd.Series:
    return s.map(_anchors_of)


@F.pandas_udf(CELLS)
def html_cells(s: pd.Series) -> pd.Series:
    return s.map(table_cells)


def cube(spark: SparkSession, document: dict) -> DataFrame:
    """A column a dimension and value, from a JSON-stat 2.0 document: the place in the list gives the coordinates.

    The driver only reads the codes of the dimensions; the values are unfolded by column arithmetic.
    """
    ids, sizes = document["id"], document["size"]
    value = document["value"]
    pairs = [(int(k), None if v is None else float(v)) for k, v in (value.items() if isinstance(value, dict) else enumerate(value))]
    rows = spark.createDataFrame(pairs, "at long, value double").filter("value IS NOT NULL")
    stride, columns = 1, {}
    for name, size in zip(reversed(ids), reversed(sizes)):
        index = document["dimension"][name]["category"]["index"]
        codes = index if isinstance(index, list) else sorted(index, key=index.get)
        columns[name] = F.element_at(F.array(*map(F.lit, codes)), (F.floor(F.col("at") / stride) % size + 1).cast("int"))
        stride *= size
    return rows.select(*(columns[n].alias(n) for n in ids), "value")


def unpivoted(rows: DataFrame, ids: list[str], period: str = "period", value: str = "value") -> DataFrame:
    """A wide table, a column a period, as rows; empty cells go."""
    wide = [c for c in rows.columns if c not in ids]
    return rows.unpivot(ids, wide, period, value).filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))


def csv_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV table with a header, all columns as text: published values stay as they are printed."""
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def log_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log; broken lines go, and records that several files hold count once."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).dropDuplicates()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without comment lines."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def status_of(text: Column, thin: int = 200) -> Column:
    """html_text, html_thin or html_only by how much text a page has."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, "html_only").when(n < thin, "html_thin").otherwise("html_text")


def xbrl_facts(xml: str) -> list[dict]:
    """element, context, unit, decimals, value of an instance's facts; equal ones count once, conflicting ones are an error."""
    import xml.etree.ElementTree as ET

    seen: dict[tuple[str, str], dict] = {}
    for node in ET.fromstring(xml):
        context = node.get("contextRef")
        if context:
            fact = {"element": node.tag.rpartition("}")[2], "context": context, "unit": node.get("unitRef"), "decimals": node.get("decimals"), "value": (node.text or "").strip()}
            if seen.setdefault((fact["element"], context), fact)["value"] != fact["value"]:
                raise ValueError(f"two values of {fact['element']} in {context}")
    return list(seen.values())


def dump(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=True)
