"""Words of texts as bytes and as 64-bit hashes, quickly."""

from __future__ import annotations

import string

import numpy as np
import xxhash

#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Turns every ASCII character that is no letter into a space.
LETTERS = bytes(b if b > 127 or chr(b) in string.ascii_letters else 32 for b in range(256))


def spaced_words(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ after lower-casing A-Z: just what bytes.split() cuts at."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    r"""Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z."""
    return text.translate(ALNUM).split()


class Hashes(dict):
    """64-bit hashes of words, of which some are kept."""

    keep = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= self.keep:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
