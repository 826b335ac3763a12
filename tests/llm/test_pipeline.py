"""The pipeline's stages on columns of any names, on nulls and empty tables, and the whole against brute force."""

import random
import zlib

import pytest

import corpus_pipeline as cp
from quillstone.llm.decontamination import decontaminated
from quillstone.llm.quality import fit, scored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, docs, labels, benchmark, schema=DOCS):
    for name, rows, ddl in (("documents", docs, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Good and junk texts with labels, exact copies, near copies and benchmark passages; nulls, an empty text, a row twice."""
    rng = random.Random(6)
    good = [(i, prose(rng, rng.randint(40, 120)) + ".") for i in range(80)]
    bad = [(i + 200, " ".join(f"{w}%%%{w}" for w in rng.choices("abcdefg", k=40))) for i in range(60)]
    items = [(i, prose(rng, 40)) for i in range(3)]
    copies = [(300 + i, good[i][1].upper()) for i in range(10)]
    near = [(400 + i, good[20 + i][1] + " " + prose(rng, 3)) for i in range(10)]
    leaks = [(500 + i, prose(rng, 30) + " " + items[i % 3][1] + " " + prose(rng, 30)) for i in range(6)]
    docs = [(i, t, "en", "s", 1) for i, t in good + bad + copies + near + leaks + [(600, None), (601, ""), (5, good[5][1])]]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    return written(spark, tmp_path_factory.mktemp("sf"), docs, labels, items), docs, items, labels


def test_the_whole_pipeline_is_brute_force(spark, small):
    """Each stage's decisions by plain loops; the quality model's are taken row by row, as each text is scored for itself."""
    sf, docs, items, labels = small
    model = fit(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    verdict = {}
    for text in {d[1] for d in docs}:
        verdict[text] = scored(spark.createDataFrame([(text,)], "text string"), model).first().predicted
    left = [d for d in docs if verdict[d[1]] == 1]
    assert not any(200 <= d[0] < 260 for d in left) and {i for i, *_ in docs if i < 80} <= {d[0] for d in left}
    best = {}
    for d in left:
        key = (d[1] or "").lower()
        best[key] = max(best.get(key, d), d, key=lambda x: x[0])
    left = sorted(best.values())

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {d[0]: shingles(d[1]) for d in left}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    left = [d for d in left if root[d[0]] == d[0]]
    left = [d for d in left if not any(t in (d[1] or "") for _, t in items)]
    pieces = cp.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == {d[0] for d in left} and len(left) < 90
    from tokenizers import Tokenizer

    import public_tokenizers

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d[0]: encode.encode(d[1] or "", add_special_tokens=False).ids + [1] for d in left}
    at = dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == p.ids_crc32
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in ids.items()}


@pytest.mark.parametrize("names", [["doc_id", "Text", "a.b", "Score", "kept"], ["Doc_Id", "text", "score", "keep_id", "column 2"]])
def test_stages_keep_columns_of_any_names(spark, small, names):
    sf, docs, *_ = small
    rows = spark.createDataFrame(docs, DOCS).toDF(*names)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == names
        got = {tuple(r) for r in out.collect()}
        assert got and got <= {tuple(d) for d in docs}
        rows = spark.createDataFrame(sorted(got, key=str), DOCS).toDF(*names)
    assert cp.STAGES[-1][1](spark, rows, sf).count() >= len(got)


def test_operators_take_columns_of_any_names(spark, small):
    sf, docs, items, _ = small
    rows = spark.createDataFrame(docs, DOCS).toDF("doc_id", "Text", "a.b", "Predicted", "xy")
    out = decontaminated(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == rows.columns and out.count() == len(docs) - 6
    assert scored(rows, None).columns == ["doc_id", "Text", "a.b", "xy", "score", "predicted"]


def test_stages_on_nothing_and_on_nulls(spark, tmp_path):
    nulls = [(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (2, "", None, None, None)]
    sf = written(spark, tmp_path, [], [], [])
    for _, stage in cp.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), sf).collect() == []
        assert stage(spark, spark.createDataFrame(nulls, DOCS), sf).count() >= 1
    assert cp.run(spark, sf).collect() == []
