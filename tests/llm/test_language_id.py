"""Segmentation-marginalised scores against a plain enumeration."""

import numpy as np
import pytest

from quillstone.llm.language_id import UNKNOWN, Pieces, expected, identify, log_probabilities, marked, words_of
from quillstone.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def pieces():
    return Pieces(tokenizer_path("piece_bpe_32k.model"))


def plain(pieces, word, p):
    """(probability, expected uses) by recursion over all segmentations."""
    number = {x: i for i, x in enumerate(pieces.names, 2)}
    total, uses = 0.0, np.zeros(pieces.size)

    def walk(at, prob, used):
        nonlocal total
        if at == len(word):
            total += prob
            for u in used:
                uses[u] += prob
            return
        for end in range(at + 1, len(word) + 1):
            i = number.get(word[at:end], 1 if end == at + 1 else 0)
            if i:
                walk(end, prob * p[i], [*used, i])

    walk(0, 1.0, [])
    return total, uses / total


def test_forward_and_expected(pieces):
    p = np.random.default_rng(1).random(pieces.size)
    p[0], p[1] = 0, UNKNOWN
    for word in ["▁the", "▁tion", "▁eaux", "▁größe", "▁日本x", "▁q☃z"]:
        total, uses = plain(pieces, word, p)
        got = log_probabilities(pieces, ["▁x", word], p[:, None])
        assert np.exp(got[1, 0]) == pytest.approx(total)
        got = expected(pieces, [word], np.array([[2.0]]), p[:, None])[:, 0]
        assert np.allclose(got, 2 * uses)


def test_words():
    assert words_of("The 2nd, ÉTÉ-été\nx") == ["the".encode(), b"nd", "été".encode(), "été".encode(), b"x"]
    assert marked("é".encode()) == "▁é"


def whole(pieces, word, p):
    """(log probability, expected uses) by plain sums over all places, in logarithms."""
    number = {x: i for i, x in enumerate(pieces.names, 2)}
    edges = [(a, b, number.get(word[a:b], 1 if b == a + 1 else 0)) for a in range(len(word)) for b in range(a + 1, min(len(word), a + pieces.longest) + 1)]
    edges = [(a, b, i) for a, b, i in edges if i]
    before, after = [0.0] + [-np.inf] * len(word), [-np.inf] * len(word) + [0.0]
    for a, b, i in sorted(edges, key=lambda e: e[1]):
        before[b] = np.logaddexp(before[b], before[a] + np.log(p[i]))
    for a, b, i in sorted(edges, key=lambda e: -e[0]):
        after[a] = np.logaddexp(after[a], after[b] + np.log(p[i]))
    uses = np.zeros(pieces.size)
    for a, b, i in edges:
        uses[i] += np.exp(before[a] + np.log(p[i]) + after[b] - before[-1])
    return before[-1], uses


def test_long_words_are_summed_whole(pieces, monkeypatch):
    rng = np.random.default_rng(4)
    p = rng.random((pieces.size, 2)) / pieces.size
    p[0], p[1] = 0, UNKNOWN
    words = ["▁donaudampfschiffahrtsgesellschaftskapitaenswitwe", "▁" + "日本語と東京" * 100, "▁" + "".join(rng.choice(list("abcdeфж"), 200)), "▁a", "▁" + "☃" * 2000, "▁the"]
    for chars in (400_000, 50):
        monkeypatch.setattr("quillstone.llm.language_id.LATTICE_CHARS", chars)
        got = log_probabilities(pieces, words, p)
        uses = expected(pieces, words, np.eye(len(words)), p[:, :1])
        for k, w in enumerate(words):
            want, parts = whole(pieces, w, p[:, 0])
            assert got[k, 0] == pytest.approx(want) and got[k, 1] == pytest.approx(whole(pieces, w, p[:, 1])[0])
            assert np.allclose(uses[:, k], parts)


def test_identify(spark):
    rows = [(i, ("the and of that is " if i % 2 else "les des que une dans ") * 3, "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !!", None), (103, "the the that", None), (None, "les des", None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(40))
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert got[None].held_out is False and got[None].lang_pred == "fr"
    assert identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert identify(unlabelled).first().lang_pred == "und"
