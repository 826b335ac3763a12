"""Token ids of public tokenizers, with a bounded cache of the ids of pieces between spaces."""

from __future__ import annotations

import codecs
import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Appended to every document.
END_ID = 1
#: Pieces that a worker keeps of the last ones seen, and as many of those before.
CACHE_PIECES = 200_000
#: Places of pieces that are filled with ids at once.
PLACES = 1 << 18
ODD_SPACE = re.compile(r"\s ")
SAFE_CUT = re.compile(r"(?<=\S)(?= )")
END = array("I", [END_ID]).tobytes()
#: Words that both kinds of vocabulary keep whole before merging; the second begins with the space before the word.
PLAIN_WORD, SPACED_WORD = re.compile("[a-z]+"), re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
# how byte-level vocabularies write a byte: as its Latin-1 character where that is printable, else by those from 256 on
_ODD_BYTES = [*range(33), *range(127, 161), 173]
BYTE_CHARS = {byte: 256 + k for k, byte in enumerate(_ODD_BYTES)}
BYTE_TABLE = "".join(chr(BYTE_CHARS.get(byte, byte)) for byte in range(256))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_byte_chars(words: list[str]) -> list[str]:
    """Words, none of which has a line feed, as byte-level vocabularies write them: all in one run."""
    return codecs.charmap_decode("\n".join(words).encode(), "strict", BYTE_TABLE)[0].split(BYTE_TABLE[10])


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit integers, equal to those of the tokenizer on the whole text.

    Both vocabularies begin a new word wherever a space follows something that is no white space, so that a text's ids
    are those of its pieces between such cuts. drops_space: the tokenizer ignores white space, so that every space (and
    line feed) is such a cut and belongs to no piece. A text in which an added token is spelt out, such as an end mark,
    is encoded whole: the tokenizer gives it that token's id.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space, self.cache, self.old = drops_space, {"": b""}, {}
        # what stands between pieces that are encoded together: one token, whatever is beside it
        self.mark = " \0 " if drops_space else "\n"
        found = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = found[0] if len(found) == 1 else None
        self.word = PLAIN_WORD if drops_space else SPACED_WORD
        if not drops_space and (self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel)):
            self.word = PLAIN_WORD

    def pieces(self, texts: list[str]) -> pa.ListArray:
        """The pieces of each text."""
        if self.drops_space:
            return pc.split_pattern(pc.replace_substring(pc.ascii_lower(pa.array(texts, pa.large_string())), "\n", " "), " ")
        if any("\0" in t for t in texts):
            return pa.array([SAFE_CUT.split(t) for t in texts], pa.list_(pa.large_string()))
        cut = [SAFE_CUT.sub("\0", t) if ODD_SPACE.search(t) else t.replace(" ", "\0 ") for t in texts]
        return pc.split_pattern(pa.array(cut, pa.large_string()), "\0")

    def atoms(self, piece: str) -> list[str]:
        """Parts of a piece that the tokenizers never join: around a lone line feed, and ASCII marks after a letter."""
        parts = [piece]
        if "\n" in piece and not self.drops_space:
            lines, words = piece.split("\n"), piece.split()
            if words[1:] == lines[1:] and len(words) == len(lines) and lines[0] in (words[0], " " + words[0]):
                parts = [x for line in lines for x in (line, "\n")][:-1]
        out = []
        for p in parts:
            word = p.rstrip(string.punctuation)
            out += (word, p[len(word) :]) if len(word) < len(p) and word[-1:].lower().isalpha() else (p,)
        return out

    def encode(self, pieces: list[str]) -> None:
        """Put the ids of these pieces into the cache: plain words by the merges alone, others by the whole tokenizer."""
        known = self.cache
        word, merge, alone = self.word.fullmatch, self.merge, []
        plain = list(filter(word, pieces))
        if len(plain) < len(pieces):
            pieces = [p for p in pieces if not word(p)]
        else:
            pieces = []
        for p, raw in zip(plain, as_byte_chars(plain)):
            known[p] = array("I", [t.id for t in merge(raw)]).tobytes()
        if self.mark_id is None:
            alone, pieces = pieces, []
        at = 0
        while at < len(pieces):
            part = pieces[at : at + 2048]
            some = [p for p in part if not ("\n" in p or "\0" in p or p[-1].isspace())]
            if len(some) < len(part):
                alone += set(part).difference(some)
            at += 2048
            ids = array("I", self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids)
            raw, cuts = ids.tobytes(), [-1, *np.flatnonzero(np.frombuffer(ids, np.uint32) == self.mark_id).tolist(), len(ids)]
            if len(cuts) != len(some) + 1:
                alone += some
                continue
            for p, first, last in zip(some, cuts, cuts[1:]):
                known[p] = raw[4 * first + 4 : 4 * last]
        for k in range(0, len(alone), 2048):
            for p, found in zip(alone[k : k + 2048], self.tokenizer.encode_batch_fast(alone[k : k + 2048], add_special_tokens=False)):
                known[p] = array("I", found.ids).tobytes()

    def learn(self, new: set[str]) -> None:
        """Put the ids of pieces that the cache lacks into it, from the generation before where that has them."""
        known, old = self.cache, self.old
        made, need = {}, set()
        if old:
            again = [p for p in new if p in old]
            known.update(zip(again, map(old.__getitem__, again)))
            new.difference_update(again)
        atoms = self.atoms
        for p in new:
            last = p[-1]
            if last.isalpha() and "\n" not in p:
                need.add(p)
                continue
            if last in ",." and p[-2:-1].lower().isalpha() and "\n" not in p:  # the usual case
                made[p] = parts = p[:-1], last
            else:
                parts = atoms(p)
                if len(parts) > 1:
                    made[p] = parts
            need.update(parts)
        need.difference_update(known)
        self.encode(list(need))
        get = known.__getitem__
        for p, parts in made.items():
            known[p] = b"".join(map(get, parts))

    def joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without added tokens: each different piece is looked up once, and its ids go to all its places."""
        lists = self.pieces(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.cache.get, pieces))
        late = [k for k, found in enumerate(parts) if found is None]
        self.learn({pieces[k] for k in late})
        for k in late:
            parts[k] = self.cache[pieces[k]]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, first = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(size) - size
        index = coded.indices.to_numpy()
        length = size[index]
        ends = np.concatenate([[0], np.cumsum(length)])
        out = np.empty(ends[-1], np.uint32)
        for a in range(0, len(index), PLACES):
            b = min(a + PLACES, len(index))
            low, high = ends[a], ends[b]
            out[low:high] = flat[np.repeat(first[index[a:b]] - (ends[a:b] - low), length[a:b]) + np.arange(high - low)]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() + END for a, b in zip(bounds, bounds[1:])]

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.old, self.cache = self.cache, {"": b""}
        whole = [k for k, t in enumerate(texts) if any(x in t for x in self.special)]
        odd = [k for k, t in enumerate(texts) if "\0" in t]
        rest = sorted(set(range(len(texts))).difference(whole, odd))
        out = {k: array("I", self.tokenizer.encode(texts[k], add_special_tokens=False).ids).tobytes() + END for k in whole}
        for group in (sorted(set(odd).difference(whole)), rest):
            if group:
                out.update(zip(group, self.joined([texts[k] for k in group])))
        return [out[k] for k in range(len(texts))]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One a worker process, as its cache is worth keeping."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = Encoder(path, drops_space)
    return _encoders[path, drops_space]


def encoded(batches, path: str, drops_space: bool, characters: int = 2_000_000):
    """(doc_id, ids with the end) for Arrow batches of doc_id and text, some characters at a time."""
    enc = encoder(path, drops_space)
    for batch in batches:
        ids, texts, total = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            total += len(texts[-1])
            if total >= characters:
                yield from zip(ids, enc.batch(texts))
                ids, texts, total = [], [], 0
        if ids:
            yield from zip(ids, enc.batch(texts))


def record_batches(rows, schema: pa.Schema, size: int = 2000):
    """Arrow batches of at most size rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
