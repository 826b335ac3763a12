"""Period texts: parsing, order, shifting and era years, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequency and the pattern of its period texts.
PATTERNS = (
    ("fq", r"^FY(\d{4})Q([1-4])$"),
    ("h", r"^FY(\d{4})H([12])$"),
    ("fy", r"^FY(\d{4})$"),
    ("q", r"^(\d{4})Q([1-4])$"),
    ("d", r"^(\d{4})-(\d{2})-(\d{2})E?$"),
    ("m", r"^(\d{4})-(0[1-9]|1[0-2])$"),
    ("a", r"^(\d{4})$"),
)
#: The year before each era's first.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018, "M": 1867, "T": 1911, "S": 1925, "H": 1988, "R": 2018}
#: How a period of each frequency is written: what stands before the year, the mark and digits of its part, parts a year.
SHAPES = {"a": ("", "", 0, 1), "fy": ("FY", "", 0, 1), "q": ("", "Q", 1, 4), "fq": ("FY", "Q", 1, 4), "h": ("FY", "H", 1, 2), "m": ("", "-", 2, 12)}


def parsed(text: Column) -> Column:
    """struct(freq, year, sub), or null if the text is no period: never a guess. (year, sub) sorts in time."""
    t = F.trim(text)
    out = F.lit(None)
    for freq, pattern in reversed(PATTERNS):
        part = lambda i: F.regexp_extract(t, pattern, i).cast("int")  # noqa: B023, E731
        sub = F.lit(0) if freq in ("a", "fy") else part(2) * 100 + part(3) if freq == "d" else part(2)
        out = F.when(t.rlike(pattern), F.struct(F.lit(freq).alias("freq"), part(1).alias("year"), sub.cast("int").alias("sub"))).otherwise(out)
    return out


def matches(text: Column, freq: Column) -> Column:
    """Whether the text is a period of this frequency; irregular series take calendar years."""
    found = parsed(text)["freq"]
    return F.coalesce(F.when(freq == "irr", found == "a").otherwise(found == freq), F.lit(False))


def shifted(text: Column, n: Column) -> Column:
    """The period n steps later at the same frequency, or null. Days count as days, and a closing mark E stays."""
    p = parsed(text)
    shape = F.create_map(*(x for f, (head, mark, digits, per) in SHAPES.items() for x in (F.lit(f), F.struct(F.lit(head).alias("head"), F.lit(mark).alias("mark"), F.lit(digits).alias("digits"), F.lit(per).alias("per")))))
    rule = F.try_element_at(shape, p["freq"])
    step = p["year"] * rule["per"] + F.greatest(p["sub"], F.lit(1)) - 1 + n
    part = F.when(rule["per"] > 1, F.concat(rule["mark"], F.lpad((F.pmod(step, rule["per"]) + 1).cast("string"), rule["digits"], F.lit("0")))).otherwise("")
    day = F.date_format(F.date_add(F.try_to_date(F.substring(F.trim(text), 1, 10)), n), "yyyy-MM-dd")
    return F.when(p["freq"] == "d", F.concat(day, F.regexp_extract(F.trim(text), "E?$", 0))).otherwise(F.concat(rule["head"], F.floor(step / rule["per"]).cast("string"), part))


#: An era, in characters or a letter, and its year.
_ERA = "(明治|大正|昭和|平成|令和|[MTSHR])(元|[0-9]{1,2})"
_ERA_DAY = f"^{_ERA}[.年]([0-9]{{1,2}})[.月]([0-9]{{1,2}})日?$"


def _era_base(era: Column, number: Column) -> Column:
    base = F.create_map(*(F.lit(x) for pair in ERAS.items() for x in pair))
    return F.try_element_at(base, era) + F.when(number == "元", 1).otherwise(number.try_cast("int"))


def era_year(text: Column) -> Column:
    """The year of an era text such as 令和8年度 or H元; full-width letters count as half-width; other texts, a bare 年 too, give null."""
    t = F.translate(F.regexp_replace(text, r"\s+", ""), "ＭＴＳＨＲ", "MTSHR")
    pattern = f"^{_ERA}(年度)?$"
    return _era_base(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2))


def era_fiscal(text: Column, needs_suffix: bool = True) -> Column:
    """The fiscal year text of an era text: 令和8年度 is FY2026. Without 年度 only if needs_suffix is false."""
    ok = F.regexp_replace(text, r"\s+", "").endswith("年度") if needs_suffix else F.lit(True)
    return F.when(ok, F.concat(F.lit("FY"), era_year(text).cast("string")))


def era_date(text: Column) -> Column:
    """The ISO date of S49.9.24 or 令和8年7月31日; no such day, or another text, gives null."""
    t, pattern = F.translate(F.trim(text), "ＭＴＳＨＲ", "MTSHR"), _ERA_DAY
    part = lambda i: F.regexp_extract(t, pattern, i)
    return F.date_format(F.try_make_timestamp(_era_base(part(1), part(2)), part(3).try_cast("int"), part(4).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)), "yyyy-MM-dd")


#: The time codes of sources, each with its patterns, most special first, and how $1, $2 ... are put together.
TIME_CODES = {
    "boj_gap_q": [(r"^(\d{4})\.([1-4])Q$", "$1Q$2")],
    "boj_gap_h": [(r"^(\d{4})\.([12])\s*:.*$", "FY$1H$2")],
    "esri_qe_quarter": [(rf"^(\d{{4}})/\s*{m}-\s*\d{{1,2}}\.?$", f"$1Q{q}") for q, m in enumerate((1, 4, 7, 10), 1)],
    "esri_year_fy": [(r"^(\d{4})$", "FY$1")],
    "esri_year_a": [(r"^(\d{4})$", "$1")],
    "esri_year_paren": [(r"^.*?[（(](\d{4})[）)].*$", "$1")],
    "esri_year_paren_fy": [(r"^.*?年度[（(](\d{4})[）)].*$", "FY$1")],
    "estat_hojin_fy": [(r"^(\d{4})0$", "FY$1")],
    "estat_hojin_fq": [(rf"^(\d{{4}}){q + 1}$", f"FY$1Q{q}") for q in (1, 2, 3)],
    "estat_cpi_time": [(r"^(\d{4})1000\d{2}$", "FY$1"), (r"^(\d{4})000000$", "$1"), (r"^(\d{4})00(0[1-9]|1[0-2])\2$", "$1-$2")],
    "estat_quarter": [(rf"^(\d{{4}})00{3 * q - 2:02}{3 * q:02}$", f"$1Q{q}") for q in (1, 2, 3, 4)],
    "estat_yyyymm": [(r"^(\d{4})(\d{2})$", "$1-$2"), (r"^(\d{4})$", "$1")],
}
TIME_CODES["estat_roudou_time"] = TIME_CODES["estat_cpi_time"] + TIME_CODES["estat_yyyymm"]
#: Sources whose codes may have white space around them.
_TRIMMED = ("boj_gap_q", "boj_gap_h", "esri_qe_quarter")


def converted(source: str, code: Column) -> Column:
    """The period text of a source's time code, or null where the code is none of the source's."""
    t = F.trim(code) if source in _TRIMMED else code
    out = F.lit(None).cast("string")
    if source == "estat_hojin_fq":  # the first calendar quarter closes the fiscal year before
        first = F.regexp_extract(t, r"^(\d{4})1$", 1).try_cast("int")
        out = F.concat(F.lit("FY"), (first - 1).cast("string"), F.lit("Q4"))
    for pattern, shape in reversed(TIME_CODES[source]):
        out = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, shape)).otherwise(out)
    return out


#: A whole country's area code, and the country's region.
COUNTRY, COUNTRY_REGION = "00000", "JP"


def region_of(code: Column) -> Column:
    """A five-digit area code as a region: the country, a prefecture's two digits, or a city's five; else null."""
    return F.when(code == COUNTRY, COUNTRY_REGION).when(code.rlike(r"^[0-9]{2}000$"), F.substring(code, 1, 2)).when(code.rlike("^[0-9]{5}$"), code)


def months_between(a: Column, b: Column) -> Column:
    """Months from YYYY-MM text a to b."""
    month = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    return month(b) - month(a)
