"""Fill-in-middle: texts cut at two places and rearranged around sentinels, with Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The units of a text, and the sentinels before prefix, suffix and middle.
UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many have the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of the seed and the id: the first hex digits of their SHA-256, eight at a time."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output (columns of these names, in any case, are replaced).

    The cuts lie after unit h1 mod (n + 1) and h2 mod (n + 1), the smaller first. Form psm has the output
    <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle, and plain the text itself, without character counts.

    A null text counts as empty; an empty text, one that holds a sentinel and one that isn't valid UTF-8 (it has no code
    points to cut at) are plain. A null doc_id is drawn for as an empty one; rows with one id are cut alike. Other columns
    may have any names. An empty table gives an empty result. A text's units are held as one array of its row.
    """
    mine = ["n", "form", "prefix_chars", "middle_chars", "output"]
    names = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine]
    text_, units_, n_, h_, a_, b_, form_, pre_, mid_, suf_ = unused(docs, "text", "units", "n", "h", "a", "b", "form", "pre", "mid", "suf")
    text = F.col(text_)
    out = docs.select(*names, F.coalesce("text", F.lit("")).alias(text_), F.array(*draws(F.col("doc_id"), seed)).alias(h_))
    # steps on columns of their own, so that nothing is computed twice
    out = out.withColumn(units_, F.regexp_extract_all(text, F.lit(UNITS), F.lit(0))).withColumn(n_, F.size(units_).cast("long"))
    h = [F.col(h_)[i] for i in range(4)]
    marked = (text == "") | ~F.is_valid_utf8(text)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(sentinel))
    form = F.when(marked | (h[2] % 100 >= rearranged), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    first, second = h[0] % (F.col(n_) + 1), h[1] % (F.col(n_) + 1)
    out = out.withColumn(form_, form).withColumn(a_, F.least(first, second).cast("int")).withColumn(b_, F.greatest(first, second).cast("int"))

    def part(since: Column, until: Column) -> Column:
        return F.when(F.col(form_) != "plain", F.array_join(F.slice(units_, since + 1, until - since), ""))

    out = out.withColumn(pre_, part(F.lit(0), F.col(a_))).withColumn(mid_, part(F.col(a_), F.col(b_))).withColumn(suf_, part(F.col(b_), F.col(n_).cast("int")))
    psm = F.concat(F.lit(PREFIX), F.col(pre_), F.lit(SUFFIX), F.col(suf_), F.lit(MIDDLE), F.col(mid_))
    spm = F.concat(F.lit(SUFFIX), F.col(suf_), F.lit(PREFIX), F.col(pre_), F.lit(MIDDLE), F.col(mid_))
    output = F.when(F.col(form_) == "plain", text).when(F.col(form_) == "psm", psm).otherwise(spm)
    return out.select(*names, F.col(n_).alias("n"), F.col(form_).alias("form"), F.length(pre_).cast("long").alias("prefix_chars"), F.length(mid_).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from, found by its sentinels alone.

    No text with a sentinel is rearranged, and no sentinel can arise where a part meets one, as < occurs at their starts
    only: each is found where it was put.
    """
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def sides(one: str, other: str) -> tuple[Column, Column]:
        return F.substring(F.substring_index(head, other, 1), len(one) + 1, 2**31 - 1), F.substring_index(head, other, -1)

    (prefix, suffix), (suffix2, prefix2) = sides(PREFIX, SUFFIX), sides(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle, suffix2))
