"""Exact deduplication by Grace hashing: complete contents compared in open-addressing tables, the rest spilled."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, hot_lookup, size_of, stored, unused
from .tokens import record_batches

#: Bytes of text that a task's table holds; what doesn't fit goes to spill files.
TABLE_BYTES = 64 << 20
FAN_OUT = 16
#: Up to so many contents with copies (under 200 bytes each) are broadcast, so that no text moves to find them; beyond, all rows are shuffled.
BROADCAST_GROUPS = 200_000
_HEAD = struct.Struct("<qqqI32s")
_SCHEMA = pa.schema([("sha", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])
_DDL = "sha binary, content binary, keep_id long, group_size long, ties long"
#: Stands for a null doc_id while ids are compared.
NO_ID = -(1 << 63)


class ContentTable:
    """Open addressing with linear probing; two entries are one if their complete contents are equal."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slots, self.entries, self.bytes = [-1] * 1024, [], 0

    def _slot(self, sha: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = int.from_bytes(sha[:8], "little") & mask
        while (at := self.slots[i]) >= 0:
            entry = self.entries[at]
            if entry[0] == sha and entry[1] == content:
                return i
            i = (i + 1) & mask
        return i

    def add(self, sha: bytes, content: bytes, keep: int, count: int, ties: int = 1) -> bool:
        """False if it is new and doesn't fit. keep: the largest doc_id of count rows; ties: those that have it."""
        i = self._slot(sha, content)
        if self.slots[i] >= 0:
            entry = self.entries[self.slots[i]]
            entry[4] = ties * (keep >= entry[2]) + entry[4] * (keep <= entry[2])
            entry[2], entry[3] = max(entry[2], keep), entry[3] + count
            return True
        if self.entries and self.bytes + len(content) + 200 > self.limit:
            return False
        self.slots[i] = len(self.entries)
        self.entries.append([sha, content, keep, count, ties])
        self.bytes += len(content) + 200
        if len(self.entries) * 2 > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for at, entry in enumerate(self.entries):
                j = int.from_bytes(entry[0][:8], "little") & mask
                while self.slots[j] >= 0:
                    j = (j + 1) & mask
                self.slots[j] = at
        return True


def _read(path: str):
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            keep, count, ties, n, sha = _HEAD.unpack(head)
            yield sha, f.read(n), keep, count, ties


def grace_groups(records, limit: int, folder: str, level: int = 0):
    """[sha, content, keep, count, ties] for each distinct content of records; folder takes the spill files.

    The first contents stay in the table. A record that is new and doesn't fit goes to one of FAN_OUT files, by a byte
    of its hash that depends on the level; each file is then treated in the same way. Copies of a content in the table
    are never written, so that a hot content costs one entry.
    """
    held, files = ContentTable(limit), {}
    for sha, content, keep, count, ties in records:
        if not held.add(sha, content, keep, count, ties):
            part = sha[8 + level % 24] % FAN_OUT
            if part not in files:
                files[part] = open(os.path.join(folder, f"{level}-{part}"), "wb")
            files[part].write(_HEAD.pack(keep, count, ties, len(content), sha) + content)
    yield from held.entries
    held.clear()
    for f in files.values():
        f.close()
    for part, f in files.items():
        inner = tempfile.mkdtemp(dir=folder)
        yield from grace_groups(_read(f.name), limit, inner, level + 1)
        os.rmdir(inner)
        os.remove(f.name)


def exact_groups(docs: DataFrame, tasks: int, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(sha binary, keep_id, group_size, ties) for each text of docs, A-Z lower-cased and null as empty.

    Each task first reduces its own rows to one a content, so that a content with a third of all rows reaches its
    bucket once a task. The buckets are dealt by hash; in each, grace_groups compares complete contents.
    """

    def local(batches):
        held = ContentTable(table_bytes)

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    content = (text.as_py() or b"").lower()
                    sha = hashlib.sha256(content).digest()
                    keep = NO_ID if doc_id is None else doc_id
                    if not held.add(sha, content, keep, 1):
                        yield from held.entries
                        held.clear()
                        held.add(sha, content, keep, 1)
            yield from held.entries

        yield from record_batches(rows(), _SCHEMA, 1000)

    def bucket(batches):
        with tempfile.TemporaryDirectory() as folder:
            rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
            groups = ([e[0], None, *e[2:]] for e in grace_groups(rows, table_bytes, folder))
            yield from record_batches(groups, _SCHEMA)

    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(local, _DDL)
    return some.repartition(tasks, F.xxhash64("sha")).mapInArrow(bucket, _DDL).drop("content")


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All rows and columns of docs with keep_id, group_size, kept and text_sha256 (of the same name as ours: replaced).

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest doc_id stays; a null doc_id is below all others. Of rows with that doc_id and the same text one is kept.
    Other columns may have any names. An empty table gives an empty result.
    """
    total, tasks = size_of(docs)
    mine = ["keep_id", "group_size", "kept", "text_sha256"]
    names = [c for c in docs.columns if c.lower() not in mine]
    keep_, size_, ties_, row_ = unused(docs, "keep", "size", "ties", "row")
    groups = exact_groups(docs, tasks, table_bytes).filter("group_size > 1")
    dup = stored(groups.select(F.lower(F.hex("sha")).alias("text_sha256"), F.col("keep_id").alias(keep_), F.col("group_size").alias(size_), F.col("ties").alias(ties_)), "copies")
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).cast("binary"), 256)
    # the texts stay behind where only other columns are asked for
    named = docs.select(*(F.col(f"`{c}`") for c in names), sha.alias("text_sha256"))
    if dup.count() <= BROADCAST_GROUPS:
        out = named.join(F.broadcast(dup), "text_sha256", "left")
    else:
        out = hot_lookup(named, dup, "text_sha256", size_, total)
    keep = F.when(F.col(size_).isNull(), F.col("doc_id").cast("long")).otherwise(F.when(F.col(keep_) > NO_ID, F.col(keep_)))

    def columns(rows: DataFrame, kept) -> DataFrame:
        return rows.select(*(F.col(f"`{c}`") for c in names), keep.alias("keep_id"), F.coalesce(size_, F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")

    best = F.col("doc_id").cast("long").eqNullSafe(keep)
    if dup.filter(F.col(ties_) > 1).isEmpty():
        return columns(out, best)
    # rows that stand twice are numbered, and the first of them is kept
    tied = best & F.coalesce(F.col(ties_) > 1, F.lit(False))
    rows = stored(stored(out.filter(tied), "tied").withColumn(row_, F.monotonically_increasing_id()), "numbered")
    first = rows.groupBy("text_sha256").agg(F.min(row_).alias("first"), F.count("*").alias("n"))
    rows = hot_lookup(rows, stored(first, "first"), "text_sha256", "n", rows.count())
    return columns(out.filter(~tied), best).union(columns(rows, F.col(row_) == F.col("first")))
