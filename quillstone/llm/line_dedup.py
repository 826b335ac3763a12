"""Line deduplication: a suffix array over line sequences by distributed prefix doubling, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_lookup, stored, unused

#: A repeated run is deleted if it has at least so many characters.
MIN_CHARS = 40
_ID = ["doc_id", "digest", "line"]
_FIRST = "struct<doc_id: bigint, digest: bigint, line: int>"


def ranked(rows: DataFrame, key: str, order: list[str], tag: str) -> DataFrame:
    """key, rank, first (doc_id, digest, line), n for each key that two rows have at least; key stands for the columns in order.

    Ranks follow those columns: the keys are dealt by ranges and numbered in order, so that no task needs more than its
    range. Rows are counted before the shuffle, so that a line with a third of all rows costs one row a task.
    """
    seen = stored(rows.groupBy(*dict.fromkeys([key, *order])).agg(F.count("*").alias("n"), F.min(F.struct(*_ID)).alias("first")).filter("n > 1"), tag)
    out = stored(seen.repartitionByRange(*order).sortWithinPartitions(*order).select(key, F.monotonically_increasing_id().alias("rank"), "first", "n"), tag)
    forget(seen)
    return out


def with_rank(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows with rank and first (null where the key isn't in names); keys with very many rows are looked up in a broadcast table."""
    return hot_lookup(rows, names, key, "n", names.agg(F.sum("n")).first()[0] or 0).drop("n")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, line number, key (128 bits of the line) and size for each line."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.split("text", "\n").alias("lines")).filter("doc_id IS NOT NULL AND lines IS NOT NULL")
    each = base.select("doc_id", "digest", F.posexplode("lines").alias("line", "text"))
    return each.select(*_ID, F.md5(F.col("text").cast("binary")).alias("key"), F.length("text").alias("size"))


def doubled(docs: DataFrame) -> list[DataFrame]:
    """For each k the places whose runs of 2^k lines occur twice at least: place, rank, chars, here, and first, the run's first place.

    Round k ranks those runs by the ranks of their two halves; a run that occurs once drops out, and doubling ends when
    none is left. The rows of one rank are an interval of the suffix array whose common prefix has 2^k lines at least.
    """
    all_lines = lines_of(docs)
    counts = stored(all_lines.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    seen = hot_lookup(all_lines, counts, "key", "n", counts.agg(F.sum("n")).first()[0] or 0).filter("n > 1").drop("n")
    now = stored(seen.dropDuplicates(_ID), "lines")
    names = ranked(now, "key", ["key"], "names")
    here = F.struct(*_ID).alias("here")
    level = stored(with_rank(now, names, "key").filter("rank IS NOT NULL").select(*_ID, "rank", F.col("size").cast("long").alias("chars"), here, "first"), "suffixes")
    forget(counts), forget(now), forget(names)
    levels, length = [], 1
    while not level.isEmpty():
        levels.append(level)
        after = level.select("doc_id", "digest", (F.col("line") - length).alias("line"), F.col("rank").alias("next"), F.col("chars").alias("more"))
        both = level.select(*_ID, F.col("rank").alias("left"), "chars").join(after, _ID)
        pairs = stored(both.select(*_ID, "left", "next", F.concat_ws(" ", "left", "next").alias("key"), (F.col("chars") + F.col("more")).alias("chars")), "pairs")
        names = ranked(pairs, "key", ["left", "next"], "names")
        level = stored(with_rank(pairs, names, "key").filter("rank IS NOT NULL").select(*_ID, "rank", "chars", here, "first"), "suffixes")
        forget(pairs), forget(names)
        length *= 2
    return levels


def longest_copies(docs: DataFrame) -> DataFrame:
    """doc_id, digest, line, length, chars, first: for each place the longest run of lines from it that also begins earlier.

    first is that run's first place. For the largest 2^k lines that begin earlier, the common prefix is extended by
    2^(k-1), ..., 1 lines: each step divides an interval of the suffix array by the rank of the lines that follow. All
    places of a part but its first move on with it; the first stays, as it may have a longer common prefix with an
    earlier place of another part, and also stands for its place in its own part. A first place stands for its part
    wherever the part is only a source, as it is the earliest.
    """
    levels = doubled(docs)
    schema = f"doc_id long, digest bigint, line int, here {_FIRST}, level int, cls bigint, length int, chars bigint, first {_FIRST}, asks boolean"
    rows = docs.sparkSession.createDataFrame([], schema)
    for k, level in enumerate(levels):
        rows = rows.union(level.select(*_ID, "here", F.lit(k).alias("level"), F.col("rank").alias("cls"), F.lit(1 << k).alias("length"), "chars", "first", (F.col("first") < F.col("here")).alias("asks")))
    # a place asks at its largest level with an earlier copy; above that level it is the first of its runs
    asks = rows.filter("asks").groupBy(*_ID).agg(F.max("level").alias("most"))
    rows = stored(rows.join(asks, _ID, "left").filter("most IS NULL OR level >= most").drop("most"), "intervals")
    names = rows.columns
    now = rows.filter(F.col("level") == len(levels) - 1)
    for j in range(len(levels) - 2, -1, -1):
        after = levels[j].select("doc_id", "digest", F.col("line").alias("at"), F.col("rank").alias("next"), F.col("chars").alias("more"))
        x = now.withColumn("at", F.col("line") + F.col("length")).join(after, ["doc_id", "digest", "at"], "left").drop("at")
        x = stored(x.withColumn("key", F.when(F.col("next").isNotNull(), F.concat_ws(" ", "level", "cls", "length", "next"))), "extended")
        parts = x.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("here").alias("origin")).filter("n > 1")
        parts = stored(parts.withColumn("part", F.monotonically_increasing_id()), "parts")
        found = hot_lookup(x.filter("key IS NOT NULL"), parts, "key", "n", parts.agg(F.sum("n")).first()[0] or 0)
        stay = F.struct("cls", "length", "chars", "first", "asks")
        more = [F.col("part").alias("cls"), (F.col("length") + (1 << j)).alias("length"), (F.col("chars") + F.col("more")).alias("chars"), F.col("origin").alias("first")]
        source, moved = F.struct(*more, F.lit(False).alias("asks")), F.struct(*more, F.col("asks"))
        is_first = F.col("origin") == F.col("here")
        forms = F.when(F.col("n").isNull(), F.array(stay)).when(is_first, F.array(stay, source)).when(F.col("asks"), F.array(moved))
        forms = found.select(*_ID, "here", "level", F.explode(forms).alias("form")).select(*_ID, "here", "level", "form.*")
        now = x.filter("key IS NULL").select(*names).union(forms.select(*names)).union(rows.filter(F.col("level") == j))
    return now.filter("asks").select(*_ID, "length", "chars", "first")


def _maximal(docs: DataFrame, min_chars: int) -> DataFrame:
    """The longest copies that no copy from the line before holds."""
    found = stored(longest_copies(docs).withColumn("stop", F.col("line") + F.col("length")), "copies")
    before = found.select("doc_id", "digest", (F.col("line") + 1).alias("line"), F.col("stop").alias("reached"))
    return found.join(before, _ID, "left").filter((F.col("reached").isNull() | (F.col("stop") > F.col("reached"))) & (F.col("chars") >= min_chars))


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, start_line, n_lines, n_chars, source_doc_id, source_line of the later copies of repeated line runs.

    Lines are cut at line feeds and are equal by 128 bits of a hash. A copy is the longest run from a line that also
    begins at an earlier place, in the order of doc_id and line; the source is the first place of the run. Copies
    within a copy from the line before are left out, so that the runs are maximal; the runs of one document may overlap.
    Runs of at least min_chars characters (without line feeds) are returned.

    Null and empty texts, and rows without doc_id, give nothing. Repeated rows (doc_id and text) count once. A run and
    its first copy may overlap, as in a document of one line many times.
    """
    return _maximal(docs, min_chars).select(
        "doc_id", F.col("line").alias("start_line"), F.col("length").alias("n_lines"), F.col("chars").alias("n_chars"), F.col("first.doc_id").alias("source_doc_id"), F.col("first.line").alias("source_line")
    )


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all rows and columns, with the later copies of repeated line runs deleted from text.

    Of rows that stand twice (doc_id and text) each keeps its own first copies; columns may have any names.
    """
    id_, digest, runs = unused(docs, "id", "digest", "runs")
    found = _maximal(docs, min_chars).groupBy(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).agg(F.collect_list(F.struct("line", "length")).alias(runs))
    out = docs.join(found, (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(digest)), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists(runs, lambda r: (i >= r.line) & (i < r.line + r.length)))
    text = F.when(F.col(id_).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
