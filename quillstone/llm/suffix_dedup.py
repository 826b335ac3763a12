"""Suffix-array deduplication: places ranked by growing prefixes on Spark until they are unique or long enough."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import hot_lookup, size_of, stored, unused

#: Strings of so many bytes that start at two places are removed.
LENGTH = 200
#: The first prefix by which places are ranked.
FIRST = 50
#: So many neighbouring places share the second prefix, of LENGTH - SHARED + 1 bytes.
SHARED = 8
#: Places of a text that are worked on at once: memory doesn't grow with a text's length.
STRETCH = 1 << 17
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for windows of a stretch."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(STRETCH + 2 * LENGTH, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return tuple(out)


def pieces_of(text: bytes, since: int) -> tuple[np.ndarray, ...]:
    """start, n, rel, anchor, content of the pieces among the places from since on, STRETCH of them at most.

    A place is the start of a LENGTH-byte window. Its anchor is the least hash of the FIRST-byte strings in its window, the
    leftmost if several are least, and rel the distance to it: both depend on the window alone, so that equal windows
    have the same. A piece is a run of places with one anchor at one position; content is a hash of all bytes of its windows.
    """
    part = np.frombuffer(text, np.uint8, min(STRETCH + LENGTH - 1, len(text) - since), since).astype(np.uint64)
    powers, inverse = _powers()
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part + np.uint64(1)) * powers[: len(part)], out=sums[1:])
    h = (sums[FIRST:] - sums[:-FIRST]) * inverse[: len(part) - FIRST + 1]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    # the position in the lower 18 bits: ties of the upper 46 go to the leftmost
    low = np.uint64((1 << 18) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - FIRST + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = (least[starts] & low).astype(np.int64)
    n = np.diff(np.append(starts, len(least)))
    content = [xxhash.xxh3_64_intdigest(text[since + s : since + s + k + LENGTH - 1]) for s, k in zip(starts.tolist(), n.tolist())]
    return starts + since, n, at - starts, h[at].view(np.int64), np.array(content, np.uint64).view(np.int64)


def _pieces(batches):
    names, held = ["row_id", "key", "starts", "ns", "rels", "anchors", "contents"], []

    def flushed():
        ids, keys, found = zip(*held)
        ends = np.cumsum([0, *(len(f[0]) for f in found)])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([f[i] for f in found]).astype(t))) for i, t in enumerate(("i4", "i4", "i4", "i8", "i8"))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), *lists], names)

    for batch in batches:
        for row_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            # a text without places has its row too, as its copies are counted by it
            for since in range(0, max(1, len(text) - LENGTH + 1), STRETCH):
                held.append((row_id, key, pieces_of(text, since) if len(text) >= LENGTH else [np.zeros(0, np.int64)] * 5))
                if len(held) == 200:
                    yield flushed()
                    held.clear()
    if held:
        yield flushed()


def condensed(docs: DataFrame) -> DataFrame:
    """row_id, key and, in arrays, the pieces of each text (a row for each stretch), stored; key is the text's SHA-256."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.sha2(body, 256).alias("key"), body.alias("text"))
    return stored(rows.mapInArrow(_pieces, "row_id long, key string, starts array<int>, ns array<int>, rels array<int>, anchors array<long>, contents array<long>"), "pieces")


def _fetched(batches):
    """Bytes of the pieces that a text is asked for: (anchor, content, row_id, start, rel, weight, bytes)."""
    out = []
    for batch in batches:
        for text, asked in zip(batch.column(0), batch.column(1).to_pylist()):
            text = text.as_py()
            for p in asked:
                out.append((p["anchor"], p["content"], p["row_id"], p["start"], p["rel"], p["weight"], text[p["start"] : p["start"] + p["n"] + LENGTH - 1]))
                if len(out) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FETCHED.types)], _FETCHED.names)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FETCHED.types)], _FETCHED.names)


_FETCHED = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("row_id", pa.int64()), ("start", pa.int32()), ("rel", pa.int32()), ("weight", pa.int32()), ("bytes", pa.binary())])
_FETCHED_DDL = "anchor long, content long, row_id long, start int, rel int, weight int, bytes binary"


def groups_of(body: bytes, rel: int) -> list[tuple[int, int, int | None]]:
    """(part, hash of the second prefix, hash of all bytes of its windows) for each group of SHARED places of a piece.

    Places are grouped by their distance to the anchor, so that equal windows fall into the same part everywhere. The
    second prefix is what all windows of a part share: the part is as a rule cut by the piece's ends, but that prefix
    lies in each of its windows. The hash of all bytes is null if the piece doesn't have all windows of the part.
    """
    last = rel - (len(body) - LENGTH)
    out = []
    for part in range(last // SHARED, rel // SHARED + 1):
        low, high = part * SHARED, part * SHARED + SHARED - 1
        whole = low >= last and high <= rel
        shared = xxhash.xxh3_64_intdigest(body[rel - low : rel - high + LENGTH])
        out.append((part, shared, xxhash.xxh3_64_intdigest(body[rel - high : rel - low + LENGTH]) if whole else None))
    return out


def _signed(x: int | None) -> int | None:
    return x if x is None or x < 1 << 63 else x - (1 << 64)


def _grouped(batches):
    names = ["anchor", "content", "part", "shared", "full", "weight"]
    for batch in batches:
        out = []
        for anchor, content, rel, weight, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
            out += [(anchor, content, part, _signed(shared), _signed(full), weight) for part, shared, full in groups_of(body, rel)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()])], names)


def _windows(batches):
    """(row_id, start, weight, hash) of each window in the parts that are asked for."""
    for batch in batches:
        out = []
        for row_id, start, rel, weight, body, parts in zip(*(batch.column(i).to_pylist() for i in range(6))):
            last = rel - (len(body) - LENGTH)
            for part in parts:
                for r in range(max(last, part * SHARED), min(rel, part * SHARED + SHARED - 1) + 1):
                    at = rel - r
                    out.append((row_id, start + at, weight, xxhash.xxh3_128_hexdigest(body[at : at + LENGTH])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int32(), pa.string()])], ["row_id", "start", "weight", "hash"])


def repeated_places(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(row_id, since, until): byte ranges of pieces' rows whose LENGTH-byte windows start at another place too.

    Round one ranks the places by their anchors' FIRST bytes: an anchor that occurs once has no repeated window. An anchor
    all of whose pieces have one content is done as well: if there are two, all their windows are repeated. The pieces of
    the others are taken once for each content, with weight 2 if it occurs twice at least. Round two ranks them, SHARED
    places at a time, by anchor and the second prefix: what is unique drops out, and what has an equal in all bytes of its
    windows is repeated. Round three ranks the windows that are left by all their LENGTH bytes.
    """
    each = pieces.select("row_id", F.explode(F.arrays_zip("starts", "ns", "rels", "anchors", "contents")).alias("p"))
    each = each.select("row_id", F.col("p.starts").alias("start"), F.col("p.ns").alias("n"), F.col("p.rels").alias("rel"), F.col("p.anchors").alias("anchor"), F.col("p.contents").alias("content"))
    counts = each.groupBy("anchor").agg(F.count("*").alias("size"), (F.min("content") != F.max("content")).alias("mixed")).filter("size > 1")
    counts = stored(counts.select(F.col("anchor").cast("string").alias("place"), "size", "mixed"), "anchors")
    total = counts.agg(F.sum("size")).first()[0] or 0
    ranked = hot_lookup(each.withColumn("place", F.col("anchor").cast("string")), counts, "place", "size", total).filter("size IS NOT NULL")
    ranked = stored(ranked.drop("place", "size"), "ranked")
    whole = ranked.filter("NOT mixed").select("row_id", F.col("start").alias("since"), (F.col("start") + F.col("n") + LENGTH - 1).alias("until"))
    mixed = ranked.filter("mixed").withColumn("place", F.concat_ws(" ", "anchor", "content"))
    kinds = stored(mixed.groupBy("place", "anchor", "content").agg(F.count("*").alias("size"), F.min(F.struct("row_id", "start", "n", "rel")).alias("first")), "contents")
    twice = kinds.filter("size > 1").select("place", "size")
    again = hot_lookup(mixed, twice, "place", "size", twice.agg(F.sum("size")).first()[0] or 0).filter("size IS NOT NULL")
    whole = whole.union(again.select("row_id", "start", F.col("start") + F.col("n") + LENGTH - 1))

    # the bytes of one piece of each content, from the texts that hold them
    asked = kinds.select(F.col("first.row_id").alias("row_id"), F.struct("anchor", "content", "first.*", F.least("size", F.lit(2)).cast("int").alias("weight")).alias("p"))
    asked = asked.groupBy("row_id").agg(F.collect_list("p").alias("asked"))
    rows = pieces.select("row_id", "key").distinct()
    copies = rows.groupBy("key").agg(F.count("*").alias("size"))
    wanted = rows.join(asked, "row_id").groupBy("key").agg(F.flatten(F.collect_list("asked")).alias("asked"))
    wanted = stored(wanted.join(copies, "key"), "wanted")
    body = F.coalesce("text", F.lit("")).cast("binary")
    texts = docs.select(F.sha2(body, 256).alias("key"), body.alias("text"))
    found = hot_lookup(texts, wanted, "key", "size", size_of(docs)[0]).filter("asked IS NOT NULL").select("text", "asked").mapInArrow(_fetched, _FETCHED_DDL)
    # copies of a text give the same pieces: one of them stays
    bytes_ = stored(found.groupBy("anchor", "content", "row_id", "start", "rel", "weight").agg(F.max("bytes").alias("bytes")), "bytes")

    groups = stored(bytes_.select("anchor", "content", "rel", "weight", "bytes").mapInArrow(_grouped, "anchor long, content long, part int, shared long, full long, weight int"), "groups")
    place = F.concat_ws(" ", "anchor", "part", "shared").alias("place")
    shared = groups.groupBy(place).agg(F.sum("weight").alias("size")).filter("size > 1")
    shared = stored(shared, "shared")
    left = stored(hot_lookup(groups.withColumn("place", place), shared, "place", "size", shared.agg(F.sum("size")).first()[0] or 0).filter("size IS NOT NULL").drop("place", "size"), "left")
    place = F.when(F.col("full").isNotNull(), F.concat_ws(" ", "anchor", "part", "full"))
    full = stored(left.groupBy(place.alias("place")).agg(F.sum("weight").alias("size")).filter("size > 1 AND place IS NOT NULL"), "full")
    judged = stored(hot_lookup(left.withColumn("place", place), full, "place", "size", full.agg(F.sum("size")).first()[0] or 0), "judged")
    at = bytes_.select("anchor", "content", "row_id", "start", "rel")
    done = judged.filter("size IS NOT NULL AND weight = 1").join(at, ["anchor", "content"])
    first = F.col("start") + F.col("rel") - SHARED * F.col("part") - (SHARED - 1)
    parts = done.select("row_id", first.alias("since"), (first + SHARED + LENGTH - 1).alias("until"))
    # partners of weight 2 are asked for too: their windows are counted, though they are settled
    open_ = judged.filter("size IS NULL").groupBy("anchor", "content").agg(F.collect_list("part").alias("parts"))
    more = judged.filter("size IS NOT NULL").join(judged.filter("size IS NULL").select("anchor", "part", "shared").distinct(), ["anchor", "part", "shared"], "left_semi")
    open_ = open_.union(more.groupBy("anchor", "content").agg(F.collect_list("part").alias("parts")))
    open_ = open_.groupBy("anchor", "content").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"))
    windows = bytes_.join(open_, ["anchor", "content"]).select("row_id", "start", "rel", "weight", "bytes", "parts")
    windows = stored(windows.mapInArrow(_windows, "row_id long, start int, weight int, hash string"), "windows")
    same = stored(windows.groupBy("hash").agg(F.sum("weight").alias("size")).filter("size > 1"), "same")
    equal = hot_lookup(windows, same, "hash", "size", same.agg(F.sum("size")).first()[0] or 0).filter("size IS NOT NULL")
    single = equal.select("row_id", F.col("start").alias("since"), (F.col("start") + LENGTH).alias("until"))
    return whole.union(parts).union(single)


def _merged(batches):
    """(row_id, spans): the maximal runs of a row's ranges."""
    for batch in batches:
        spans = []
        for ranges in batch.column(1).to_pylist():
            out = []
            for since, until in sorted((r["since"], r["until"]) for r in ranges):
                if out and since <= out[-1]["until"]:
                    out[-1]["until"] = max(out[-1]["until"], until)
                else:
                    out.append({"since": since, "until": until})
            spans.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["row_id", "spans"])


_SPANS = pa.list_(pa.struct([("since", pa.int32()), ("until", pa.int32())]))
_SPANS_DDL = "array<struct<since:int,until:int>>"


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with kept (binary) and spans (columns of these names, in any case, are replaced).

    A byte of a text, as UTF-8, is removed if a LENGTH-byte string over it also starts at another place: of another row or
    of the same text, overlapping or not, as the texts came in. spans are the maximal runs (since, until) of removed bytes,
    and kept is what is left; it may end within a character. So nothing is left of a long text that stands twice.

    A null text counts as empty; texts under LENGTH bytes stay whole. Rows that stand twice are rows of their own. The ids
    don't matter; other columns may have any names. An empty table gives an empty result. Contents are compared by 128 bits.
    """
    names = [c for c in docs.columns if c.lower() not in ("kept", "spans")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    key_, spans_, size_ = unused(docs, "key", "spans", "size")
    pieces = condensed(docs)
    ranges = repeated_places(docs, pieces).groupBy("row_id").agg(F.collect_list(F.struct("since", "until")).alias("ranges"))
    spans = ranges.mapInArrow(_merged, f"row_id long, spans {_SPANS_DDL}")
    rows = pieces.select("row_id", "key").distinct()
    copies = rows.groupBy("key").agg(F.count("*").alias(size_))
    # copies of a text have the same spans
    found = rows.join(spans, "row_id").groupBy("key").agg(F.first("spans").alias(spans_))
    found = stored(found.join(copies, "key").withColumnRenamed("key", key_), "spans")
    body = F.coalesce("text", F.lit("")).cast("binary")
    out = hot_lookup(docs.withColumn(key_, F.sha2(body, 256)), found, key_, size_, size_of(docs)[0])
    # columns go by position, as their names may be anything
    at = [c.lower() for c in names].index("text")
    plain = out.select(*(F.col(f"`{c}`").cast("binary") if i == at else F.col(f"`{c}`") for i, c in enumerate(names)), F.col(spans_)).toDF(*(f"c{i}" for i in range(len(names))), "spans")
    schema = StructType([*plain.schema.fields[:-1], StructField("kept", BinaryType()), plain.schema["spans"]])

    def cut(batches):
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch.column(at), batch.column(len(names)).to_pylist()):
                text, since, parts = text.as_py() or b"", 0, []
                for span in found or []:
                    parts.append(text[since : span["since"]])
                    since = span["until"]
                kept.append(b"".join([*parts, text[since:]]))
                spans.append(found or [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary()), pa.array(spans, _SPANS)], [*batch.schema.names[:-1], "kept", "spans"])

    done = plain.mapInArrow(cut, schema)
    return done.select(*(F.col(f"c{i}").cast(docs.schema[i].dataType).alias(c) for i, c in enumerate(names)), "kept", "spans")
