"""Merkle manifests, fill-in-middle and suffix deduplication against brute force and on edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import merkle, suffix_dedup
from quillstone.llm.fill_in_middle import fill_in_middle, restored
from quillstone.llm.merkle import folded, manifest, proof_digest, traverse
from quillstone.llm.queries import LEAF
from quillstone.llm.suffix_dedup import groups_of, pieces_of, without_repeats

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- Merkle manifest


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out += run[: i % 16] + run[i % 16 + 1 :]
        i //= 16
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 256, 257, 300, 4095, 4096])
def test_traversal_gives_the_siblings(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = brute_levels(leaves)
    for i, sides in enumerate(traverse(leaves, merkle.levels_of(n))):
        assert "".join(a + b for a, b in sides) == "".join(brute_siblings(levels, i))


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(field, r)))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: brute_levels([leaf for *_, leaf in sorted(trees[s])]) for s in names}
    top = brute_levels([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (has, doc_id, leaf) in enumerate(sorted(trees[s])):
            proof = brute_siblings(levels[s], i) + brute_siblings(top, k)
            out.append((doc_id if has else None, leaf, levels[s][-1][0], top[-1][0], sha("".join(proof))))
    return Counter(out)


def test_manifest_is_that_of_brute_force(spark):
    """One source with most rows, one with a single row, a null source, ties, repeated rows and nulls in every column."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "é", None, "b", ""]), rng.choice(["en", None]), i % 7 or None, rng.choice([f"Text {i}", "", None, "wörter"])) for i in range(600)]
    rows += [(5, "hot", None, 5, "tie"), (5, "hot", None, 5, "other"), (9, "hot", None, 1, "twice"), (9, "hot", None, 1, "twice"), (None, "hot", None, None, None), (1, "lone", "x", 2, "y" * 50_000)]
    rows += [(k, f"s{k}", None, None, None) for k in range(40)]
    df = spark.createDataFrame([(*r, "x", 1, "p") for r in rows], DOCS + ", `a.b` string, leaf int, Proof string").repartition(7)
    got = manifest(df, LEAF).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), folded(F.col("leaf"), F.col("proof"))).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_manifest(rows)
    assert all(r[5] == r.root for r in got)


def test_manifest_climbs_over_several_rounds(spark):
    """More than one block: 9000 rows of one source, numbered over several tasks."""
    rows = [(i, "hot" if i % 3 else "cold", None, None, str(i)) for i in range(9000)]
    got = manifest(spark.createDataFrame(rows, DOCS).repartition(5), LEAF).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof"))).collect()
    assert Counter(map(tuple, got)) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest(spark.createDataFrame([], DOCS), LEAF).collect() == []


def test_a_changed_leaf_folds_to_another_root(spark):
    df = spark.createDataFrame([(i, "s", None, None, "T") for i in range(20)], DOCS)
    got = manifest(df, LEAF, carry={"other": F.sha2(F.lit("x").cast("binary"), 256)}).select("root", folded(F.col("other"), F.col("proof")).alias("r")).collect()
    assert len({r.r for r in got}) == 20 and all(r.r != r.root for r in got)


# --- fill-in-middle


def test_fill_in_middle(spark):
    texts = [None, "", "a", "<", "has <P> in it", "x <S", "Ünï 漢字 🎉 words\n\ttoo", "word " * 20_000, "<<M<S<P text <M", "12345"]
    rows = [(i + 100 * k, t) for k in range(30) for i, t in enumerate(texts)] + [(None, "no id at all"), (7, "same id"), (7, "same id")]
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], "doc_id long, text string, `a.b` string, N int, Output string")
    got = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert df.select("`a.b`").columns[0] in got[0].asDict() and len(got) == len(rows)
    import re

    forms = Counter()
    for r in got:
        text = r.text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        h = [int(sha(f"1:{'' if r.doc_id is None else r.doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want = ("plain", None, None, text)
        elif h[3] % 100 < 20:
            want = ("spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
        else:
            want = ("psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == (len(units), *want, text)
        forms[r.form] += 1
    assert len(forms) == 3
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fill_in_middle_of_a_long_text_and_of_broken_bytes(spark):
    df = spark.range(1, 6).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é a"), 700_000).alias("text"))
    got = fill_in_middle(df).select("n", (restored(F.col("output"), F.col("form")) == F.col("text")).alias("same")).collect()
    assert all(r.n == 2_100_000 and r.same for r in got)
    df = spark.sql("SELECT id AS doc_id, CAST(X'61FF62' AS STRING) AS text FROM range(9)")
    assert {r.form for r in fill_in_middle(df).select("form").collect()} == {"plain"}


def test_fill_in_middle_stays_in_the_jvm(spark):
    plan = fill_in_middle(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- suffix deduplication


def brute_repeats(texts):
    size = suffix_dedup.LENGTH
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + size] for b in bodies for k in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]), spans))
    return out


def repeated_texts():
    """Copies, shifted and overlapping passages, edits at all distances, periods, and many pieces around one passage."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghéj", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    hot, out = prose(45), [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "b" * 900, "word " * 1500, "ab" * 333, "xyz" * 70 + "q"]
    base = prose(300)
    out += [base, base, base[1:], base[300:700], prose(40) + base[250:455] + prose(40), prose(30) + base[800:1000] + prose(9), base[:600] + "X" + base[601:]]
    for _ in range(60):
        text = list(base)
        for _ in range(rng.randint(1, 12)):
            text[rng.randrange(len(text))] = rng.choice("ABC")
        out.append("".join(text))
    out += [prose(rng.randint(1, 60)) + hot + prose(rng.randint(0, 60)) for _ in range(80)]
    out += [hot[k : k + 200] for k in range(0, 60, 7)] + [prose(rng.randint(1, 200)) for _ in range(60)] + [hot + hot]
    return out


def test_removed_bytes_are_those_of_brute_force(spark):
    texts = repeated_texts()
    df = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in enumerate(texts)], "doc_id long, Text string, `a.b` string, Kept string, key int").repartition(6)
    got = {r.doc_id: r for r in without_repeats(df).collect()}
    assert without_repeats(df).columns == ["doc_id", "Text", "a.b", "key", "kept", "spans"]
    for i, (kept, spans) in enumerate(brute_repeats(texts)):
        assert (bytes(got[i].kept), [tuple(s) for s in got[i].spans]) == (kept, spans), i
        assert got[i].Text == texts[i] and got[i]["a.b"] == "x"


def test_repeated_rows_and_nothing(spark):
    body = "0123456789" * 7 + "abc" * 50
    df = spark.createDataFrame([(1, body), (1, body), (None, "z" * 100), (None, None)], "doc_id long, text string")
    got = [(len(r.kept), len(r.spans)) for r in without_repeats(df).collect()]
    assert sorted(got) == [(0, 0), (0, 1), (0, 1), (100, 0)]
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_windows_have_equal_anchors_wherever_they_are_cut(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choices(b"ab \n", k=5000))
    place = {}
    for start, n, rel, anchor, _ in zip(*(x.tolist() for x in pieces_of(text, 0))):
        for k in range(n):
            place[start + k] = (anchor, rel - k)
    other = b"zz" * 40 + text[1000:3000]
    for start, n, rel, anchor, _ in zip(*(x.tolist() for x in pieces_of(other, 17))):
        for k in range(n):
            if start + k >= 80:
                assert place[start + k - 80 + 1000] == (anchor, rel - k)
    assert len(place) == 4801


def test_the_second_prefix_lies_in_every_window_of_its_group():
    body = bytes(random.Random(1).choices(range(256), k=287))
    import xxhash

    for part, shared, full in groups_of(body, 120):
        prefix = body[120 - 8 * part : 120 - 8 * part - 7 + 200]
        assert len(prefix) == 193 and xxhash.xxh3_64_intdigest(prefix) == shared
        for r in range(max(8 * part, 120 - 87), min(8 * part + 7, 120) + 1):
            assert prefix in body[120 - r : 120 - r + 200]
        assert (full is None) == (8 * part < 33 or 8 * part + 7 > 120)
