"""Packing of tokenised documents into windows by the online sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoded, record_batches, tokenizer_path

WINDOW = 2048
#: Characters that are encoded at once: the more, the fewer the pieces that are looked up again.
CHARACTERS = 4_000_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """An item goes to the fill level (0: a new window) after which the squared counts of partly filled windows sum to least.

    counts[h] is the number of open windows filled to h. Pieces are (doc_id, start, ids as bytes, doc_tokens). Only open
    windows hold ids; a full window is handed out at once.
    """

    def __init__(self, window: int):
        self.window = window
        self.counts = [0] * (window + 1)
        self.open: dict[int, list[list]] = {}
        # by window - level, so that of equals the fullest comes first: what a window more, or one less, adds to the sum
        self.more = np.ones(window + 1, np.int64)
        self.more[0] = 0  # a full window is no longer counted
        self.less = np.full(window + 1, 1 << 60, np.int64)
        self.less[window] = 0  # a new window is taken from nowhere

    def _count(self, level: int, change: int) -> None:
        n = self.counts[level] = self.counts[level] + change
        at = self.window - level
        self.more[at] = 2 * n + 1
        self.less[at] = 1 - 2 * n if n else 1 << 60

    def put(self, size: int, piece) -> list | None:
        """The window's pieces if that fills it."""
        n = self.window
        level = n - size - int((self.more[: n - size + 1] + self.less[size:]).argmin())
        if level:
            self._count(level, -1)
            pieces = self.open[level].pop()
        else:
            pieces = []
        pieces.append(piece)
        if level + size == n:
            return pieces
        self._count(level + size, 1)
        self.open.setdefault(level + size, []).append(pieces)
        return None

    def rest(self) -> list[list]:
        """Windows from what is still open: cut at will to fill each other; the last part is cut into powers of two."""
        flat = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        total = sum(len(p[2]) // 4 for p in flat)
        targets = [self.window] * (total // self.window)
        targets += [1 << b for b in range(self.window.bit_length(), -1, -1) if total % self.window >> b & 1]
        out, now = [], []
        at = iter(targets)
        room = next(at, 0)
        for doc_id, start, ids, n in flat:
            while ids:
                cut = ids[: 4 * room]
                now.append((doc_id, start, cut, n))
                start, ids, room = start + len(cut) // 4, ids[len(cut) :], room - len(cut) // 4
                if not room:
                    out.append(now)
                    now, room = [], next(at, 0)
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, drops_space: bool = False, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs needs doc_id and text; a null text counts as empty, so that it has the end id alone. Each task packs the rows
    of its own partition, without a shuffle: sequence_id is the partition's number times 2^40 plus a count. Documents
    beyond a window fill windows of their own, and what is left of them is packed. At the end of a partition the open
    windows are cut to fill each other, and the last part becomes sequences whose lengths are powers of two: no padding.
    So the sequences depend on how docs is partitioned and ordered; that each id lies in one piece does not. An empty table gives no rows; rows with one doc_id are packed each for itself.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        base, serial = TaskContext.get().partitionId() << 40, 0
        levels = SumOfSquares(window)

        def rows_of(pieces):
            nonlocal serial
            at = 0
            for doc_id, start, ids, n in pieces:
                yield doc_id, start, len(ids) // 4, zlib.crc32(ids), n, base + serial, at
                at += len(ids) // 4
            serial += 1

        def rows():
            for doc_id, ids in encoded(batches, path, drops_space, CHARACTERS):
                n = len(ids) // 4
                whole = n // window * window
                for start in range(0, whole, window):
                    yield from rows_of([(doc_id, start, ids[4 * start : 4 * (start + window)], n)])
                if n > whole and (full := levels.put(n - whole, (doc_id, whole, ids[4 * whole :], n))):
                    yield from rows_of(full)
            for pieces in levels.rest():
                yield from rows_of(pieces)

        yield from record_batches(rows(), _SCHEMA, 5000)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DDL)
