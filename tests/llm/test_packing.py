"""Packing encodes many texts at once, with the same pieces."""

import pyarrow as pa

from quillstone.llm import packing, tokens


def test_pieces_are_looked_up_once_for_many_texts(monkeypatch):
    calls = []

    class Counting:
        def batch(self, texts):
            calls.append(len(texts))
            return [tokens.END] * len(texts)

    monkeypatch.setattr(tokens, "encoder", lambda path, drops_space: Counting())
    rows = pa.RecordBatch.from_arrays([pa.array(range(39)), pa.array(["x" * 100_000] * 39)], ["doc_id", "text"])
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run([rows]))

    monkeypatch.setattr(packing, "F", type("F", (), {"col": staticmethod(lambda name: type("Col", (), {"cast": lambda self, t: self})())}))
    out = packing.pack(Docs(), "any")
    assert sum(b.num_rows for b in out) == 39
    assert calls == [39]
