"""Language identification by unigram pieces whose segmentations are summed by a forward algorithm."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .tokens import record_batches, tokenizer_path
from .words import LETTERS

#: Characters of words that are summed at once, and steps after which sums are scaled, far from what a double can't hold.
LATTICE_CHARS, SCALE_STEPS = 400_000, 16
#: Probability of a character that is no piece.
UNKNOWN = 1e-7
SMOOTH = 0.5
CACHE_WORDS = 300_000
#: Distinct words of which a task sums the expected counts at once.
BATCH_WORDS = 150_000
_MUL = np.uint64(0x100000001B3)
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BITS = 18
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters and of characters beyond ASCII, in UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split()


def marked(word: bytes) -> str:
    return "▁" + word.decode()


class Pieces:
    """A fixed vocabulary of pieces, found by a rolling hash of their prefixes. Id 0 is none, id 1 a character that is no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i).lower() for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.names = sorted(names)
        self.size = len(self.names) + 2
        self.longest = max(map(len, self.names))
        known = {self._hash(p[:k]): 0 for p in self.names for k in range(1, len(p) + 1)}
        known |= {self._hash(p): i for i, p in enumerate(self.names, 2)}
        keys, ids = np.array(list(known), np.uint64), np.array(list(known.values()), np.int32)
        self.tables = []
        for spread in _SPREAD:
            at = ((keys * spread) >> np.uint64(64 - _BITS)).astype(np.int64)
            _, first = np.unique(at, return_index=True)
            full, place = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.int32)
            full[at[first]], place[at[first]] = keys[first], ids[first]
            self.tables.append((spread, full, place))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids = keys[rest], ids[rest]
        self.more = dict(zip(keys.tolist(), ids.tolist()))  # what the tables had no room for

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MUL) + ord(c) + 1) & (1 << 64) - 1
        return h

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is a prefix of a piece, the piece's id or 0)."""
        found, out = np.zeros(len(keys), bool), np.zeros(len(keys), np.int32)
        left = np.arange(len(keys))
        for spread, full, place in self.tables:
            mine = keys[left]
            at = ((mine * spread) >> np.uint64(64 - _BITS)).astype(np.int64)
            there = full[at]
            same = there == mine
            found[left[same]] = True
            out[left[same]] = place[at[same]]
            left = left[~same & (there != 0)]  # another key has the place: it may be in the next table
            if not len(left):
                return found, out
        for i, key in zip(left.tolist(), keys[left].tolist()):
            if key in self.more:
                found[i], out[i] = True, self.more[key]
        return found, out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, first place, length, id) of all pieces in the words, in four arrays."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), sizes)
        begins = np.cumsum(sizes) - sizes
        stop = (begins + sizes)[word]
        at, h, found = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
        for length in range(1, self.longest + 1):
            h = h * _MUL + chars[at + length - 1]
            prefix, ids = self.lookup(h)
            if length == 1:
                ids[ids == 0] = 1
            some = ids > 0
            found.append((at[some], np.full(int(some.sum()), length), ids[some]))
            prefix &= at + length < stop[at]
            at, h = at[prefix], h[prefix]
            if not len(at):
                break
        at, length, ids = (np.concatenate(c) for c in zip(*found))
        return word[at], at - begins[word[at]], length, ids


def summed(word: np.ndarray, step: np.ndarray, length: np.ndarray, ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, longest: int):
    """(totals, logs): sums over all ways to reach step t of a word by pieces that end there, as logarithms.

    p is pieces by languages. totals has those of the words' ends, logs those of every step of every word, for the first
    language. Only the last steps that a piece can reach back to are held, and they are scaled as they shrink.
    """
    n, langs, ring = len(sizes), p.shape[1], longest + 1
    order = np.lexsort((word, step))
    word, step, length, ids = word[order], step[order], length[order], ids[order]
    bounds = np.searchsorted(step, np.arange(int(sizes.max(initial=0)) + 2))
    alpha, scale, totals = np.zeros((ring, n, langs)), np.zeros((n, langs)), np.zeros((n, langs))
    alpha[0] = 1
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    logs = np.zeros(int((sizes + 1).sum()))
    for t in range(1, len(bounds) - 1):
        some = slice(bounds[t], bounds[t + 1])
        w = word[some]
        if not len(w):
            break
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        here = w[first]
        now = np.add.reduceat(alpha[(t - length[some]) % ring, w] * p[ids[some]], first)
        alpha[t % ring, here] = now
        log = np.log(now) + scale[here]
        logs[begins[here] + t] = log[:, 0]
        ends = sizes[here] == t
        totals[here[ends]] = log[ends]
        if t % SCALE_STEPS == 0:
            alpha[:, here] /= now
            scale[here] = log
    return totals, logs


def parts_of(words: list[str]):
    """Indices of words, the shortest first, in parts of at most LATTICE_CHARS characters, or of one word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    part = np.cumsum(sizes[order]) // LATTICE_CHARS
    return np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []


def log_probabilities(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Of each word the logarithm of its probability in each language, summed over all segmentations of the whole word."""
    out = np.zeros((len(words), p.shape[1]))
    for at in parts_of(words):
        some = [words[i] for i in at]
        word, first, length, ids = pieces.lattice(some)
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        out[at] = summed(word, first + length, length, ids, sizes, p, pieces.longest)[0]
    return out


def expected(pieces: Pieces, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows) by language (columns) if words occur weight times in each; p is one column."""
    out = np.zeros((pieces.size, weight.shape[1]))
    with np.errstate(divide="ignore"):
        log_p = np.log(p[:, 0])
    for at in parts_of(words):
        some = [words[i] for i in at]
        word, first, length, ids = pieces.lattice(some)
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        total, before = summed(word, first + length, length, ids, sizes, p, pieces.longest)
        _, after = summed(word, sizes[word] - first, length, ids, sizes, p, pieces.longest)
        begin = (np.cumsum(sizes + 1) - (sizes + 1))[word]
        share = np.exp(before[begin + first] + log_p[ids] + after[begin + sizes[word] - first - length] - total[word, 0])
        for lang in range(weight.shape[1]):
            out[:, lang] += np.bincount(ids, share * weight[at[word], lang], pieces.size)
    return out


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def train(docs: DataFrame, vocabulary: str):
    """(languages, probabilities by piece and language) from text and lang of docs.

    One step of expectation-maximisation from equal probabilities: each task sums the expected uses of the pieces over
    its own words, so that at most pieces x languages rows a task are shuffled.
    """
    known = docs.filter("lang IS NOT NULL")
    langs = sorted(r[0] for r in known.select(F.col("lang").cast("string")).distinct().collect())
    if not langs:
        return [], None
    number = {x: i for i, x in enumerate(langs)}

    def run(batches):
        pieces = pieces_of(vocabulary)
        p = np.full((pieces.size, 1), 1 / pieces.size)
        p[0], p[1] = 0, UNKNOWN
        total = np.zeros((pieces.size, len(langs)))
        seen = [Counter() for _ in langs]

        def flush():
            words = sorted({w for c in seen for w in c})
            if words:
                total[:] += expected(pieces, list(map(marked, words)), np.array([[c[w] for w in words] for c in seen], float).T, p)
            for c in seen:
                c.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                seen[number[lang.as_py()]].update(words_of(text.as_py() or ""))
                if sum(map(len, seen)) > BATCH_WORDS:
                    flush()
        flush()
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    got = known.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    size = pieces_of(vocabulary).size
    p = np.full((size, len(langs)), SMOOTH)
    p[got.piece, got.lang] += got.n
    p[:2] = 0
    p /= p.sum(0)
    p[1] = UNKNOWN
    return langs, p


class Scorer:
    """Log probabilities of words by language, of which some are kept."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.known, self.rows = {}, np.zeros((1024, p.shape[1]))

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(words)
        first = len(self.known)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.known.update(zip(new, range(first, first + len(new))))
        self.rows[first : first + len(new)] = log_probabilities(self.pieces, list(map(marked, new)), self.p)

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        self.learn(set().union(*texts))
        get = self.known.__getitem__
        return np.array([self.rows[np.fromiter(map(get, w), np.int64, len(w))].sum(0) for w in texts])


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang).

    Learned from rows whose crc32 remainder by 3 is not 1 and whose lang is not null. A text without a letter, a null
    text, and any text if nothing was learned, is `und` with score 0; else score is the share of the best language in
    the likelihoods. Of equals the language that sorts first is taken. A row without doc_id is no held-out row.
    """
    vocabulary = vocabulary or tokenizer_path("piece_bpe_32k.model")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    langs, p = train(docs.select("doc_id", "text", "lang").filter(~held), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((langs, p))

    def run(batches):
        langs, p = shared.value
        scorer = Scorer(pieces_of(vocabulary), p) if langs else None

        def rows():
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    ids, out, texts = batch.column(0)[k : k + 256].to_pylist(), batch.column(1)[k : k + 256].to_pylist(), batch.column(2)[k : k + 256].to_pylist()
                    words = [words_of(t or "") for t in texts]
                    some = [i for i, w in enumerate(words) if langs and w and (texts[i].isascii() or any(map(str.isalpha, texts[i])))]
                    found = {}
                    if some:
                        z = scorer.score([words[i] for i in some])
                        z = np.exp(z - z.max(1, keepdims=True))
                        z /= z.sum(1, keepdims=True)
                        found = {i: (langs[b], float(s)) for i, b, s in zip(some, z.argmax(1), z.max(1))}
                    for i, (doc_id, h) in enumerate(zip(ids, out)):
                        yield doc_id, h, *found.get(i, ("und", 0.0))

        yield from record_batches(rows(), _OUT)

    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
