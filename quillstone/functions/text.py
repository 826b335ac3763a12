"""Text normalisation, shingles, chunking and small classifiers, as column expressions where Spark has them."""

from __future__ import annotations

import difflib
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility-normalised text; Spark has no built-in for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def name_key(name: Column) -> Column:
    """For comparing names: NFKC, no white space, no company suffix, lower case."""
    return F.lower(F.regexp_replace(nfkc(name), r"\s+|株式会社|\(株\)|(?i)(co\.,?ltd\.?|inc\.?)$", ""))


#: What separates a query's words, and what stands together as one word beside other letters.
SEPARATORS, LATIN = r"\s\p{Z}、,，・/／", r"0-9A-Za-z._%\-"


def query_words(query: Column) -> Column:
    """The different words of a search, in order: cut at separators, and where Latin letters or digits meet other letters."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(f"[{LATIN}]+|[^{LATIN}{SEPARATORS}]+"), F.lit(0)))


def version_key(name: Column, origins: list[str]) -> Column:
    """The first two parts of a file name from these origins, which its versions share; null for others and shorter names."""
    parts = F.split(name, "_")
    return F.when(parts[0].isin(origins) & (F.size(parts) > 2), F.substring_index(name, "_", 2))


def tokens(text: Column) -> Column:
    """Runs of letters and digits. No lower-casing and no stop words."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def char_shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is one shingle. The text is cut into characters once, not searched for each."""
    chars = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    at = lambda cs: F.sequence(F.lit(1), F.greatest(F.size(cs) - n + 1, F.lit(1)))
    # as a lambda's argument the characters are made once, not for each place
    each = F.transform(chars, lambda cs: F.transform(at(cs), lambda i: F.array_join(F.slice(cs, i, F.lit(n)), "")))
    return F.array_distinct(each[0])


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def sentences(text: Column, marks: str = "。！？") -> Column:
    """Split after the marks and at line feeds; blank pieces go. Marks of other scripts also stand inside numbers and names."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(mark + "\n"))
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: s != "")


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of size characters, each beginning size - overlap after the one before."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def bounded_parts(pieces: Column, limit: int) -> Column:
    """Pieces joined in order into parts of at most limit characters; a longer piece is a part of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, x):
        first = acc["now"] == ""
        joined = F.when(first, x).otherwise(F.concat(acc["now"], F.lit(" "), x))
        state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))
        fits = first | (F.length(acc["now"]) + F.length(x) + 1 <= limit)
        return F.when(fits, state(acc["done"], joined)).otherwise(state(F.concat(acc["done"], F.array(acc["now"])), x))

    return F.aggregate(pieces, empty, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def is_number(text: Column) -> Column:
    """A plain decimal with sign or exponent; no separators, dashes or marks."""
    return text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def plain_decimal(value: Column) -> Column:
    """A decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def cell_number(text: Column) -> Column:
    """A number from a table cell: separators and unit words go, a leading triangle is a minus; else null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[△▲]\s*", "-"), r"[,\s]|円|百万円|千円|%", "")
    return F.when(is_number(t), t.try_cast("decimal(38,6)"))


def column_letters(index: Column) -> Column:
    """Spreadsheet column letters of a zero-based index below 18278."""
    letter = lambda x: F.char((F.lit(65) + x).cast("int"))
    one, two = index < 26, index < 702
    return F.when(one, letter(index)).when(two, F.concat(letter(F.floor(index / 26) - 1), letter(index % 26))).otherwise(
        F.concat(letter(F.floor((index - 702) / 676)), letter(F.floor((index - 702) / 26) % 26), letter((index - 702) % 26))
    )


def half_up(value: Column, digits: int) -> Column:
    """Rounded half up, with no negative zero."""
    out = F.round(value.cast("decimal(30,10)"), digits)
    return F.when(out == 0, F.abs(out)).otherwise(out)


def rule_chain(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that the text has."""
    out = F.lit(other)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def client_label(agent: Column) -> Column:
    """claude or chatgpt by what the user agent begins with (fixed values), else other; null is other."""
    a = F.lower(F.trim(F.coalesce(agent, F.lit(""))))
    return F.when((a == "claude-user") | a.startswith("claude-user/"), "claude").when(a.startswith("openai-mcp/"), "chatgpt").otherwise("other")


def mentioned(text: Column, names: dict[str, list[str]]) -> Column:
    """The groups whose names the text has, by their first place: the longest names first, whose characters then count for no other."""
    found = F.array().cast("array<struct<at:int,group:string>>")
    for name, group in sorted(((n, g) for g, ns in names.items() for n in ns), key=lambda p: -len(p[0])):
        at = F.instr(text, F.lit(name))
        found = F.concat(found, F.when(at > 0, F.array(F.struct(at.alias("at"), F.lit(group).alias("group")))).otherwise(F.array().cast("array<struct<at:int,group:string>>")))
        text = F.replace(text, F.lit(name), F.lit("\x00" * len(name)))
    return F.array_distinct(F.transform(F.array_sort(found), lambda f: f["group"]))


def unit_of(decimals: Column) -> Column:
    """The last place that a value with so many decimals is given to: 10^-decimals, or 0 if that isn't known."""
    return F.when(decimals.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), -decimals))


def obs_status(code: Column) -> Column:
    names = {"E": "estimated", "F": "forecast", "P": "provisional", "B": "break", "A": "normal"}
    return F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), code)


@F.pandas_udf(T.StringType())
def unit_id(key: pd.Series) -> pd.Series:
    """A name-based id (version 5)."""
    return key.map(lambda k: None if k is None else str(uuid.uuid5(uuid.NAMESPACE_URL, k)))


def close_matches(word: str, vocabulary: list[str], n: int = 5, ratio: float = 0.6) -> list[str]:
    return difflib.get_close_matches(word, vocabulary, n, ratio)
