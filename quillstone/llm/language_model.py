"""A word bigram model by deleted interpolation, with weights by context frequency learned on leave-one-out counts.

Bigrams are the longest n-grams: a corpus has about as many distinct trigrams as words, so their exchange would cost
twice that of words and bigrams together, for contexts of which most occur once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, remainder, stored
from .tokens import record_batches
from .words import Hashes, mixed, odd_numbers, spaced_words

#: Characters of a block, the unit that counts are asked for.
BLOCK_CHARS = 8_000_000
#: Buckets of the table of blocks, at most: what Spark allows.
MOST_FILES = 100_000
#: Distinct n-grams that a reducer sums at once, about.
REDUCER_KEYS = 1_500_000
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = odd_numbers(2, 17)
#: Contexts with counts from 2^(b - 1) to 2^b - 1 share their weights; 0 is for contexts never seen.
BUCKETS = 48
#: Steps of the grid on which the logarithms of probabilities are counted for the weights, per octave.
GRID = 4
_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("keys", pa.binary()), ("tokens", pa.binary()), ("n_train", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_BLOCK_DDL = "block long, doc_ids array<long>, lengths array<long>, held array<boolean>, keys binary, tokens binary, n_train long, n_docs long, n_tokens long"


def packed(keys: np.ndarray) -> bytes:
    """Sorted integers as differences of as many bytes as the largest needs."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[0].tobytes() + step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(rest) + 1, 8), np.uint8)
    step[1:, :width] = rest
    step = step.view("<u8").ravel()
    step[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    return np.cumsum(step, dtype=np.uint64)


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of up to BLOCK_CHARS characters: sorted distinct word hashes, and the texts as places in them."""

    def run(batches):
        base, serial = TaskContext.get().partitionId() << 32, 0
        hashes = Hashes()
        ids, held, parts, size = [], [], [], 0

        def block():
            nonlocal serial
            keys, places = np.unique(np.concatenate(parts), return_inverse=True)
            lengths = [len(p) for p in parts]
            out_of = np.repeat(np.array(held), lengths)
            kind = "<u2" if len(keys) < 65536 else "<u4"
            serial += 1
            return base + serial, list(ids), lengths, list(held), packed(keys), places.astype(kind).tobytes(), int((~out_of).sum()), held.count(False), len(places)

        def rows():
            nonlocal size
            for batch in batches:
                for doc_id, text, h in zip(batch.column(0), batch.column(1), batch.column(2)):
                    text = text.as_py() or b""
                    ids.append(doc_id.as_py())
                    held.append(bool(h.as_py()))
                    parts.append(np.append(hashes.of(spaced_words(text)), END))
                    size += len(text)
                    if size >= BLOCK_CHARS:
                        yield block()
                        ids.clear(), held.clear(), parts.clear()
                        size = 0
            if ids:
                yield block()

        yield from record_batches(rows(), _BLOCK, 1)

    held = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), held).mapInArrow(run, _BLOCK_DDL)


class Block:
    """A block's words and bigrams."""

    def __init__(self, lengths, held, keys: bytes, tokens: bytes):
        self.lengths = np.array(lengths, np.int64)
        self.held = np.array(held, bool)
        self.keys = unpacked(keys)
        n = int(self.lengths.sum())
        self.tokens = np.frombuffer(tokens, "<u2" if len(tokens) == 2 * n else "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = ~np.repeat(self.held, self.lengths)
        hashes = self.keys[self.tokens]
        before = np.roll(hashes, 1)
        before[self.starts] = START
        self.pairs, self.pair_places = np.unique(mixed(before * _PAIR[0] + hashes * _PAIR[1]), return_inverse=True)

    def counts(self):
        """(keys, training counts) of words and of bigrams."""
        return (
            (self.keys, np.bincount(self.tokens[self.train], minlength=len(self.keys))),
            (self.pairs, np.bincount(self.pair_places[self.train], minlength=len(self.pairs))),
        )

    def context_counts(self, words: np.ndarray, docs: int) -> np.ndarray:
        """How often each token's predecessor occurs in training, the start of a text as often as there are texts."""
        c = np.roll(words[self.tokens], 1)
        c[self.starts] = docs
        return c


def count_ngrams(store: DataFrame, n_tokens: int) -> DataFrame:
    """(block, kind, bucket, counts, known): for each block its words' (kind 0) and bigrams' (1) counts in all training texts.

    Each block asks for its distinct n-grams, with its own counts, from the reducers that have them, one row a reducer
    with sorted hashes; the answer has the summed counts in the same order. Reducers have ranges of hashes, which are
    evenly filled however often an n-gram occurs. A block has a row a range, but never more than it has n-grams. known is the number of the range's words in training, on one row a
    range of words.
    """
    buckets = max(partitions(store.sparkSession), n_tokens // REDUCER_KEYS + 1)

    def ask(batches):
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("own", pa.binary())])

        def rows():
            for batch in batches:
                for block, lengths, held, keys, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                    for kind, (hashes, own) in enumerate(Block(lengths, held, keys, tokens).counts()):
                        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                        edges = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
                        for b in range(buckets):
                            lo, hi = edges[b], edges[b + 1]
                            if hi > lo:
                                yield b, kind, block, packed(hashes[lo:hi]), shrunk(own[lo:hi])

        yield from record_batches(rows(), schema, 500)

    def answer(table: pa.Table) -> pa.Table:
        out = []
        kinds = np.array(table["kind"])
        for kind in (0, 1):
            part = table.filter(pa.array(kinds == kind))
            keys = [unpacked(k) for k in part["keys"].to_pylist()]
            if not keys:
                continue
            own = np.concatenate([np.frombuffer(o, f"<u{o[0]}", offset=1) for o in part["own"].to_pylist()])
            distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(places, own, len(distinct)).astype(np.int64)
            known, at = int((total > 0).sum()) if kind == 0 else 0, 0
            for block, bucket, k in zip(part["block"].to_pylist(), part["bucket"].to_pylist(), keys):
                out.append((block, kind, bucket, shrunk(total[places[at : at + len(k)]]), known))
                known, at = 0, at + len(k)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))], ["block", "kind", "bucket", "counts", "known"])

    asked = store.select("block", "lengths", "held", "keys", "tokens").mapInArrow(ask, "bucket int, kind int, block long, keys binary, own binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block long, kind int, bucket int, counts binary, known long")


def shrunk(counts: np.ndarray) -> bytes:
    """Counts in the narrowest kind of integer, whose width in bytes comes first."""
    most = int(counts.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def joined(counts: list) -> np.ndarray:
    """The counts of a block, from its answers in the order of the ranges."""
    return np.concatenate([np.frombuffer(c, f"<u{c[0]}", offset=1) for c in counts]).astype(np.int64)


def level_of(context: np.ndarray) -> np.ndarray:
    """The bucket of a context count."""
    return (np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1) * (context > 0)).astype(np.int64)


def learn_weights(histogram, n: int, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket by expectation-maximisation.

    histogram: (bucket, grid place of bigram probability or None, of word probability or None, number of events). Places
    are logarithms in steps of 1/GRID octave relative to the uniform probability. Buckets without events take the
    weights of all events, or of the word and uniform parts where there is no context.
    """
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    if len(histogram):
        level, two, one, events = (np.array(c) for c in zip(*histogram))
        p = np.stack([np.where(two == NONE, 0, 2.0 ** (two / GRID)), np.where(one == NONE, 0, 2.0 ** (one / GRID)), np.ones(len(two))], 1)

        def em(some):
            w = np.array([0.5, 0.4, 0.1])
            for _ in range(rounds):
                share = p[some] * w
                share /= share.sum(1, keepdims=True)
                w = events[some] @ share / events[some].sum()
                w = np.maximum(w, 1e-9)
                w /= w.sum()
            return w

        weights[:] = em(np.ones(len(level), bool))
        for b in np.unique(level):
            weights[b] = em(level == b)
    weights[0, 1:] = weights[0, 1:] / weights[0, 1:].sum()
    weights[0, 0] = 0
    return weights


NONE = -100_000


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Tokens are words cut at ASCII white space, A-Z lower-cased, and one end; null is empty. base_score is the smoothed
    unigram; score mixes the bigram's, the word's and a uniform probability (1 by the known words and one more), by
    weights of the context's frequency bucket. The weights are learned by expectation-maximisation on deleted counts:
    each training token is predicted from the counts of all other training tokens. Training texts are scored with the
    full counts. Words are told apart by 64-bit hashes. Rows without doc_id are training rows. Without training
    texts all probabilities are those of one unknown word. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    name, path = f"quillstone_blocks_{uuid.uuid4().hex}", new_path(spark, "blocks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # bucketed by block, about one a bucket, so that later passes read it without another shuffle
    files = min(MOST_FILES, size // BLOCK_CHARS + 1)
    blocks(docs).write.option("compression", "zstd").bucketBy(files, "block").option("path", path).saveAsTable(name)
    store = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and store reads them
    n, n_docs, all_tokens = (x or 0 for x in store.agg(F.sum("n_train"), F.sum("n_docs"), F.sum("n_tokens")).first())
    answers = stored(count_ngrams(store, all_tokens), "counts")
    v = answers.agg(F.sum("known")).first()[0] or 0
    by_block = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "bucket", "counts"))).alias("answers"))
    whole = store.join(by_block.hint("merge"), "block").select("doc_ids", "lengths", "held", "keys", "tokens", F.transform(F.filter("answers", lambda a: a.kind == 0), lambda a: a.counts).alias("words"), F.transform(F.filter("answers", lambda a: a.kind == 1), lambda a: a.counts).alias("pairs"))
    uniform = 1 / (v + 1)

    def read(batch):
        for doc_ids, lengths, held, keys, tokens, words, pairs in zip(*(batch.column(i) for i in range(7))):
            block = Block(lengths.as_py(), held.as_py(), keys.as_py(), tokens.as_py())
            words = joined(words.as_py())
            yield doc_ids.as_py(), block, words, block.context_counts(words, n_docs), joined(pairs.as_py())[block.pair_places]

    def events(batches):
        for batch in batches:
            for _, block, words, context, pair in read(batch):
                t = block.train
                word, context, pair = words[block.tokens][t], context[t], pair[t]
                with np.errstate(divide="ignore", invalid="ignore"):
                    two = np.log2((pair - 1) / (context - 1) / uniform)
                    one = np.log2((word - 1) / max(n - 1, 1) / uniform)
                two, one = (np.where(np.isfinite(x), np.rint(np.where(np.isfinite(x), x, 0) * GRID), NONE).astype(np.int64) for x in (two, one))
                code, times = np.unique((level_of(context) << 40) + ((two - NONE) << 20) + (one - NONE), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code >> 40), pa.array((code >> 20 & 0xFFFFF) + NONE), pa.array((code & 0xFFFFF) + NONE), pa.array(times)], ["level", "two", "one", "n"])

    # as many rows as the grid has places, however large the corpus
    histogram = whole.mapInArrow(events, "level long, two long, one long, n long").groupBy("level", "two", "one").agg(F.sum("n")).collect()
    weights = learn_weights(sorted(histogram), n, v)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

        def rows():
            for batch in batches:
                for doc_ids, block, words, context, pair in read(batch):
                    word = words[block.tokens]
                    w = weights[level_of(context)]
                    p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * uniform
                    base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
                    sums = [np.add.reduceat(x, block.starts) for x in (word > 0, base, np.log10(p))]
                    yield from zip(doc_ids, block.held.tolist(), block.lengths.tolist(), sums[0].tolist(), [n] * len(doc_ids), sums[1].tolist(), sums[2].tolist())

        yield from record_batches(rows(), schema, 5000)

    return whole.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
