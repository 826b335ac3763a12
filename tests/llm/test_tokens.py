"""The cached encoder against the tokenizer on whole texts."""

import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import tokens
from quillstone.llm.tokens import Encoder, tokenizer_path

VOCABULARIES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
ENCODERS = {name: Encoder(tokenizer_path(name), drops) for name, drops in VOCABULARIES}
PARTS = ["a", "The", "word", " ", "  ", "\n", "\n\n", ",", ".", "'s", "'", "1", "23", "é", "ß", "ΑΣ", "İ", "\t", "\x1c", "\x85", " ", "́", "日本", "🙂", "\0", "<|endoftext|>", "%%%", "!!", "\r\n", "!", "…", "Ñandú", " łódźɏ", "ªº", "naïve."]


PLAIN = {name: Tokenizer.from_file(tokenizer_path(name)) for name, _ in VOCABULARIES}


def direct(name, text):
    """What the library itself gives."""
    return array("I", [*PLAIN[name].encode(text, add_special_tokens=False).ids, tokens.END_ID]).tobytes()


@pytest.mark.parametrize("name", ENCODERS)
def test_mixtures(name):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(1500)]
    encoder = ENCODERS[name]
    assert encoder.mark_id is not None
    for text, got in zip(texts, encoder.batch(texts)):
        assert got == direct(name, text), repr(text)


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=4)), max_size=12))
def test_any_text(name, parts):
    text = "".join(parts)
    assert ENCODERS[name].batch([text]) == [direct(name, text)]


@pytest.mark.parametrize("name", ENCODERS)
def test_small_cache_gives_the_same(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    encoder = ENCODERS[name]
    for k in range(20):
        texts = [f"one two three{k}, four{k % 3}.\nFive six{j}" for j in range(3)]
        assert encoder.batch(texts) == [direct(name, t) for t in texts]


def test_added_tokens_are_those_of_the_library():
    assert list(array("I", ENCODERS["byte_bpe_50k.json"].batch(["a <|endoftext|> b"])[0])) == [64, 220, 50256, 275, 1]
    for name in ENCODERS:
        for text in ("<|endoftext|>", "x<|startoftext|>Y <|ENDOFTEXT|>", "two <|endoftext|><|endoftext|>\n"):
            assert ENCODERS[name].batch(["plain", text, "Plain"]) == [direct(name, t) for t in ("plain", text, "Plain")]


def test_encoder_gets_bounded_parts(monkeypatch):
    """What a worker holds at once is bounded: ten texts of 0.4 million characters come in two parts, not in one."""
    import pyarrow as pa

    class Counting:
        parts = []

        def batch(self, texts):
            self.parts.append(sum(map(len, texts)))
            return [b""] * len(texts)

    monkeypatch.setattr(tokens, "encoder", lambda *_: Counting())
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["x" * 400_000] * 10)], ["doc_id", "text"])
    assert [i for i, _ in tokens.encoded([batch], "", True)] == list(range(10)) and Counting.parts == [2_000_000, 2_000_000]


def test_words_are_written_in_bytes_all_in_one_run():
    """Every letter that plain words have, as the library's byte level writes it; a run of words takes one table look-up a byte."""
    from tokenizers.pre_tokenizers import ByteLevel

    words = [f"{space}a{chr(c)}z" for space in ("", " ") for c in range(65, 0x250) if tokens.SPACED_WORD.fullmatch(f"a{chr(c)}z")]
    assert len(words) > 800
    assert tokens.as_byte_chars(words) == ["".join(p for p, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(w)) for w in words]
    assert all(tokens.BYTE_TABLE[b] == chr(tokens.BYTE_CHARS.get(b, b)) for b in range(256))
