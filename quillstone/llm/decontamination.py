"""Benchmark decontamination by spaced seeds: fixed masks over word positions, then checked overlaps around the hits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, stored
from .tokens import record_batches
from .words import Hashes, alnum_words, mixed, odd_numbers

#: Positions of a mask that count (1); substitutions at the others don't matter.
MASKS = ("111111", "11101011", "110110011", "1010110111")
#: An overlap needs so many equal words, or this share of a shorter benchmark text.
MIN_MATCHED, MIN_SHARE = 12, 0.8
#: Of an overlap's words at least 3 of 4 are equal: a substituted word costs what so many equal ones gain.
SUBSTITUTION = 3
#: Words of benchmark texts in one index. More are treated index by index, in as many passes over the documents.
INDEX_WORDS = 2_000_000
TABLE_BITS = 22
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64())])
_DDL = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matched long"
OFFSETS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
FACTORS = [odd_numbers(len(o), 100 + i) for i, o in enumerate(OFFSETS)]


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """A hash of the words under the mask, for each place where it fits."""
    n = len(hashes) - int(OFFSETS[mask][-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for offset, factor in zip(OFFSETS[mask], FACTORS[mask]):
        out += hashes[offset : offset + n] * factor
    return mixed(out)


def longest_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, matched) of the stretch with the most equal words of which at least 3 of 4 words are equal."""
    run = np.concatenate([[0], np.cumsum(np.where(equal, 1, -SUBSTITUTION))])
    count = np.concatenate([[0], np.cumsum(equal)])
    begins = np.flatnonzero(equal)
    if not len(begins):
        return 0, 0, 0
    # the last end from whose sum, or a later one, the sum at the beginning is reached
    later = np.maximum.accumulate(run[::-1])[::-1]
    ends = np.searchsorted(-later, -run[begins], "right") - 1
    matched = count[ends] - count[begins]
    best = int(np.argmax(matched))
    begin, end = int(begins[best]), int(begins[np.searchsorted(begins, ends[best]) - 1]) + 1
    return begin, end, int(matched[best])


class SeedIndex:
    """Seeds of benchmark texts: for each mask sorted hashes with item and place, and one table of bits for a first look."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.masks = []
        for mask in range(len(MASKS)):
            found = [(seeds(h, mask), i) for i, (_, h) in enumerate(items)]
            keys = np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)])
            item = np.repeat([i for _, i in found], [len(k) for k, _ in found]).astype(np.int64)
            place = np.concatenate([np.arange(len(k)) for k, _ in found] or [np.zeros(0, np.int64)])
            order = np.argsort(keys, kind="stable")
            self.masks.append((keys[order], item[order], place[order]))
            self.table[keys >> np.uint64(64 - TABLE_BITS)] = True

    def overlaps(self, h: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """item: (doc_start, item_start, n_words, n_matched) of its best overlap with a text of these word hashes."""
        lines = set()
        for mask, (keys, item, place) in enumerate(self.masks):
            mine = seeds(h, mask)
            for at in np.flatnonzero(self.table[mine >> np.uint64(64 - TABLE_BITS)]).tolist():
                lo, hi = np.searchsorted(keys, mine[at], "left"), np.searchsorted(keys, mine[at], "right")
                lines.update(zip(item[lo:hi].tolist(), (at - place[lo:hi]).tolist()))
        best: dict[int, tuple[int, int, int, int]] = {}
        for i, shift in lines:
            theirs = self.items[i][1]
            first, last = max(0, shift), min(len(h), shift + len(theirs))
            equal = h[first:last] == theirs[first - shift : last - shift]
            begin, end, matched = longest_stretch(equal)
            if matched >= min(MIN_MATCHED, math.ceil(MIN_SHARE * len(theirs))) and matched > best.get(i, (0, 0, 0, 0))[3]:
                best[i] = (first + begin, first + begin - shift, end - begin, matched)
        return best


def indexes(benchmark: DataFrame, words: int) -> Iterator[SeedIndex]:
    """Indexes of at most so many words each (or of one text), read row by row."""
    hashes, items, total = Hashes(), [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    for item_id, text in rows.toLocalIterator():
        h = hashes.of(alnum_words(text.encode()))
        if total + len(h) > words and items:
            yield SeedIndex(items)
            items, total = [], 0
        items.append((item_id, h))
        total += len(h)
    if items:
        yield SeedIndex(items)


def passes(docs: DataFrame, benchmark: DataFrame, index_words: int, step, join) -> DataFrame | None:
    """join over step(docs so far, broadcast index); with several indexes each pass is stored before the next index is sent.

    The driver holds two indexes at most, and a task one.
    """
    out, rest = None, indexes(benchmark, index_words)
    now = next(rest, None)
    only = True
    while now is not None:
        following = next(rest, None)
        only = only and following is None
        shared = docs.sparkSession.sparkContext.broadcast(now)
        found = step(docs if out is None else join(docs, out), shared)
        if not only:
            found = stored(found, "pass")
            shared.unpersist()
        out = found if out is None else join(out, found, True)
        now = following
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_matched): the best overlap of each document with each item.

    Words are runs of letters and digits, A-Z lower-cased. Candidates are places where a document and an item agree
    under a mask; on their diagonal the stretch with the most equal words is taken of which at least 3 of 4 are equal.
    Texts of fewer words than the shortest mask, empty and null ones give nothing; repeated rows give repeated results,
    and a row without doc_id or item_id has null for it. An empty table on either side gives an empty result.
    """

    def step(_: DataFrame, shared) -> DataFrame:
        def run(batches):
            hashes = Hashes()

            def rows():
                for batch in batches:
                    for doc_id, text in zip(batch.column(0), batch.column(1)):
                        for i, found in shared.value.overlaps(hashes.of(alnum_words(text.as_py() or b""))).items():
                            yield doc_id.as_py(), shared.value.items[i][0], *found

            yield from record_batches(rows(), _OUT)

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _DDL)

    out = passes(docs, benchmark, index_words, step, lambda a, b, found=False: a.union(b) if found else a)
    return docs.sparkSession.createDataFrame([], _DDL) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of docs, with all their columns (of any names), that overlap with no benchmark text; null texts and ids are no overlap."""
    return by_position(docs, lambda rows: _clean(rows, benchmark, index_words))


def _clean(docs: DataFrame, benchmark: DataFrame, index_words: int) -> DataFrame:
    place = docs.columns.index("text")

    def step(left: DataFrame, shared) -> DataFrame:
        def run(batches):
            hashes = Hashes()
            for batch in batches:
                clean = [not shared.value.overlaps(hashes.of(alnum_words((text.as_py() or "").encode()))) for text in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return left.mapInArrow(run, left.schema)

    out = passes(docs, benchmark, index_words, step, lambda a, b, found=False: b)
    return docs if out is None else out
