"""The corpus operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.decontamination import decontaminated, find_leaks
from quillstone.llm.exact_dedup import ContentTable, exact_dedup, grace_groups
from quillstone.llm.language_model import learn_weights, packed, score_texts, shrunk, unpacked
from quillstone.llm.license_scan import Templates, scan
from quillstone.llm.line_dedup import repeated_runs, without_repeated_lines
from quillstone.llm.near_dedup import near_deduplicated, near_duplicates
from quillstone.llm.packing import SumOfSquares, pack
from quillstone.llm.quality import bradley_terry, cut, fit, quality, scored
from quillstone.llm.token_output import TokenFile, dac_encode, token_files
from quillstone.llm.words import alnum_words

DOC = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (None, "some text of no id"), (4, "one two three"), (5, "ONE two three"), (6, "word " * 30_000), (7, "line\n" * 500), (7, "line\n" * 500)]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def texts(n, seed=1):
    """Invented texts with exact copies, near copies at all distances, shared passages and lines."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base) if rng.random() < 0.8 else " ".join(base).upper())
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice([1, 4, 30, 80, 150]))))
    return list(enumerate(out))


# --- exact deduplication


def test_grace_recursion_finds_all_groups(tmp_path):
    rng = random.Random(2)
    contents = [bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(3000)]
    import hashlib

    rows = [(hashlib.sha256(c).digest(), c, i, 1, 1) for i, c in enumerate(contents)]
    got = {e[1]: (e[2], e[3]) for e in grace_groups(iter(rows), 700, str(tmp_path))}
    assert got == {c: (max(i for i, x in enumerate(contents) if x == c), n) for c, n in Counter(contents).items()}
    assert not list(tmp_path.iterdir())


def test_table_compares_contents_not_hashes():
    t = ContentTable(10_000)
    same = b"h" * 32
    assert t.add(same, b"a", 1, 1) and t.add(same, b"b", 2, 1) and t.add(same, b"a", 9, 1)
    assert [(e[1], e[2], e[3]) for e in t.entries] == [(b"a", 9, 2), (b"b", 2, 1)]


def test_texts_stay_where_they_are_when_few_have_copies(spark, monkeypatch):
    """Contents with copies are broadcast up to a bound, whatever Spark's own threshold; beyond it the result is the same."""
    from quillstone.llm import exact_dedup as module

    docs = spark.createDataFrame([(i, f"Text {i % 40}") for i in range(60)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = module.exact_dedup(docs)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(module, "BROADCAST_GROUPS", 0)
        assert sorted(few.collect()) == sorted(module.exact_dedup(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_dedup(spark):
    rows = texts(300) + EDGES + [(7, "line\n" * 500), (None, "some text of no id")]
    df = frame(spark, [(*r, "x", k, k, k) for k, r in enumerate(rows)], DOC + ", kept string, _k int, _size int, _keep int")
    got = exact_dedup(df, table_bytes=3000).collect()
    assert len(got) == len(rows) == len({r._k for r in got})
    norm = lambda t: (t or "").encode().lower()
    groups = Counter(norm(t) for _, t in rows)
    best = {k: max((i for i, t in rows if norm(t) == k and i is not None), default=None) for k in groups}
    for r in got:
        assert (r.group_size, r.keep_id) == (groups[norm(r.text)], best[norm(r.text)])
        assert not r.kept or r.doc_id == best[norm(r.text)]
    assert Counter(norm(r.text) for r in got if r.kept) == dict.fromkeys(groups, 1)
    assert exact_dedup(frame(spark, [])).count() == 0


# --- near duplicates


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_are_those_of_brute_force(spark):
    rows = texts(400, 3) + [(i + 1000, t) for i, t in EDGES if i is not None]
    got = near_duplicates(frame(spark, rows).repartition(5)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_of_a_dense_region_are_those_of_brute_force(spark):
    """1100 texts on one template, similar at 0.67 to 0.78, so that few links are among very many near misses."""
    rng = random.Random(11)
    rows = []
    for i in range(1100):
        text = [f"w{k}" for k in range(400)]
        for k in rng.sample(range(0, 400, 5), 8):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join(text)))
    want = dense_components([t for _, t in rows])
    assert 700 < len(set(want.tolist())) < 1000
    got = near_duplicates(frame(spark, rows).repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want.tolist()))


def dense_components(texts):
    """The smallest place that links lead to, by comparing all pairs as a matrix product."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    common = [s for s, n in Counter(s for x in sets for s in x).items() if n > 1]
    has = np.array([[s in x for s in common] for x in sets], np.float32)
    shared, size = (has @ has.T).astype(int), np.array([len(x) for x in sets])
    linked = (100 * shared >= 75 * (size[:, None] + size - shared)) | np.eye(len(texts), dtype=bool)
    want, last = np.arange(len(texts)), None
    while last is None or (want != last).any():
        want, last = np.where(linked, want, len(texts)).min(1), want
    return want


def test_dense_regions_whatever_the_partitions_and_batches(spark, monkeypatch):
    """1200 texts of one template with 4 to 8 of 220 words replaced: very many pairs on both sides of 0.75."""
    import quillstone.llm.near_dedup as nd

    rng = random.Random(5)
    base = [f"w{k}" for k in range(220)]
    rows = []
    for i in range(1200):
        text = list(base)
        for k in rng.sample(range(220), rng.randint(4, 8)):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join(text)))
    want = dict(enumerate(dense_components([t for _, t in rows]).tolist()))
    assert 300 < len(set(want.values())) < 1100
    for parts, batch, block in ((1, "10000", 8192), (4, "200", 300), (9, "10000", 300)):
        monkeypatch.setattr(nd, "BLOCK", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = near_duplicates(frame(spark, rows).repartition(parts)).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_duplicates_edges(spark):
    got = near_duplicates(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert by[1].kept and by[2].kept and by[3].kept and by[None].kept and by[1].n_shingles == 0
    assert by[5].component_id == 4 and not by[5].kept
    assert near_duplicates(frame(spark, [])).count() == 0
    extra = frame(spark, [(4, "a b", "c"), (5, "A b", "d")], DOC + ", component_id string")
    assert near_deduplicated(extra).collect() == [(4, "a b", "c")]


def test_near_deduplication_goes_by_rows(spark):
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "totally different words stand here", 3), (7, "one row twice over", 4), (7, "one row twice over", 5), (None, "a b c d e f", 6), (None, None, 7)]
    clash = frame(spark, [(*r, r[2], r[2]) for r in rows], DOC + ", _gone int, _id int, mark int")
    got = near_deduplicated(clash)
    assert got.columns == clash.columns
    assert sorted(r.mark for r in got.collect() if r.doc_id != 7) == [1, 3, 6, 7] and sum(r.doc_id == 7 for r in got.collect()) == 1
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(clash).collect() if r.doc_id is not None)
    assert found == [(1, 1, True), (2, 1, False), (2, 2, True), (7, 7, True), (7, 7, True)]


# --- line deduplication


def brute_runs(rows, min_chars):
    """For each place the longest run that also begins at an earlier place, by comparing all pairs of places line by line."""
    docs = dict(sorted({(i, t): None for i, t in rows if i is not None and t is not None}, key=lambda d: d[0]))
    seqs = {i: t.split("\n") for i, t in docs.items()}
    places = [(i, k) for i in seqs for k in range(len(seqs[i]))]
    longest = {}
    for at, (i, k) in enumerate(places):
        best = (0, None)
        for j, m in places[:at]:
            n = 0
            while k + n < len(seqs[i]) and m + n < len(seqs[j]) and seqs[i][k + n] == seqs[j][m + n]:
                n += 1
            if n > best[0]:
                best = (n, (j, m))
        longest[i, k] = best
    runs = []
    for (i, k), (n, source) in longest.items():
        before = longest.get((i, k - 1), (0, None))[0] + k - 1
        if n and k + n > max(before, k) and sum(map(len, seqs[i][k : k + n])) >= min_chars:
            runs.append((i, k, n, *source))
    return sorted(runs)


def test_line_runs_are_those_of_brute_force(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices("abc ", k=12)) for _ in range(25)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)] + [(99, "x\n" * 9), (100, None), (101, "")]
    rows += [(200 + i, "\n".join(rng.choices("pq", k=30))) for i in range(5)]
    got = repeated_runs(frame(spark, rows + rows[:3]), 20).collect()
    assert sorted((r.doc_id, r.start_line, r.n_lines, r.source_doc_id, r.source_line) for r in got) == brute_runs(rows, 20)


def test_an_earlier_part_of_a_run_hides_nothing(spark):
    a, b, c = "aaaaaaaaaaaaaaa", "bbbbbbbbbbbbbbb", "ccccccccccccccc"
    got = repeated_runs(frame(spark, [(1, f"{b}\n{c}"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}")])).collect()
    assert [tuple(r) for r in got] == [(3, 0, 3, 45, 2, 0)]


def test_line_dedup_edges(spark):
    clash = frame(spark, [(1, "a line\nx", 1, 2, 3), (2, "a line\ny", 4, 5, 6)], DOC + ", _id int, __id int, _runs int")
    out = without_repeated_lines(clash, 5).orderBy("doc_id")
    assert out.columns == clash.columns and [tuple(r) for r in out.collect()] == [(1, "a line\nx", 1, 2, 3), (2, "y", 4, 5, 6)]
    assert repeated_runs(frame(spark, [])).count() == 0
    rows = [(1, "a common line\nown", "p"), (2, "other\na common line", "q"), (3, None, "r")]
    out = without_repeated_lines(frame(spark, rows, DOC + ", line string"), 5).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "a common line\nown", "p"), (2, "other", "q"), (3, None, "r")]
    assert repeated_runs(frame(spark, EDGES)).count() >= 1


# --- language model


def test_packed_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        assert (unpacked(packed(keys)) == keys).all()
    assert shrunk(np.array([1, 300]))[0] == 2


def test_weights_prefer_what_predicts():
    w = learn_weights([(3, 40, 8, 90), (3, -100_000, 8, 10)], 100, 10)
    assert w[3, 0] > 0.8 and w[0, 0] == 0 and np.allclose(w.sum(1), 1)


def brute_scores(tokens, train, counts, pairs, n, v):
    """log10 probabilities by the mixture, with weights from plain expectation-maximisation over all training tokens."""
    contexts = lambda ws: [0, *ws[:-1]]
    seen = lambda c: len(train) if c == 0 else counts[c]
    level = lambda c: min(c.bit_length(), 47)
    grid = lambda x: 2 ** (round(4 * math.log2(x * (v + 1))) / 4) if x > 0 else 0
    events = Counter()
    for i in train:
        for c, w in zip(contexts(tokens[i]), tokens[i]):
            two = (pairs[c, w] - 1) / (seen(c) - 1) if seen(c) > 1 else 0
            events[level(seen(c)), grid(two), grid((counts[w] - 1) / max(n - 1, 1))] += 1

    def em(some):
        w = [0.5, 0.4, 0.1]
        for _ in range(60):
            new = [0, 0, 0]
            for (_, two, one), k in some.items():
                parts = [w[0] * two, w[1] * one, w[2]]
                for x in range(3):
                    new[x] += k * parts[x] / sum(parts)
            new = [max(x / sum(some.values()), 1e-9) for x in new]
            w = [x / sum(new) for x in new]
        return w

    everything = em(events)
    weights = {b: em({e: k for e, k in events.items() if e[0] == b}) for b in {e[0] for e in events}}
    unseen = weights.get(0, everything)
    weights[0] = [0, *(x / sum(unseen[1:]) for x in unseen[1:])]
    out = {}
    for i, ws in tokens.items():
        total = 0
        for c, w in zip(contexts(ws), ws):
            k = weights.get(level(seen(c)), everything)
            total += math.log10(k[0] * pairs[c, w] / max(seen(c), 1) + k[1] * counts[w] / n + k[2] / (v + 1))
        out[i] = total
    return out


def test_language_model(spark):
    rows = texts(200, 6) + [(1000, None), (1001, "")]
    got = {r.doc_id: r for r in score_texts(frame(spark, rows).repartition(4)).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    pairs = Counter(p for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for p in zip([0, *ws], ws))
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    scores = brute_scores(tokens, {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}, counts, pairs, n, v)
    for i in tokens:
        assert got[i].score == pytest.approx(scores[i], rel=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_texts(frame(spark, [])).count() == 0
    assert score_texts(frame(spark, EDGES)).count() == len(EDGES)


# --- packing and token files


def test_sum_of_squares_takes_the_best_level():
    q, rng = SumOfSquares(16), random.Random(3)
    for _ in range(500):
        size = rng.randint(1, 15)
        before = list(q.counts)
        best = min(sum((c + (h == t and h < 16) - (h == f and h > 0)) ** 2 for h, c in enumerate(before) if h < 16) for f in range(17 - size) if f == 0 or before[f] for t in [f + size])
        q.put(size, (0, 0, b"", 0))
        assert sum(c * c for c in q.counts[:16]) == best


def plain_ids(name, text):
    """The library's ids and the end, as bytes."""
    from tokenizers import Tokenizer

    from quillstone.llm.tokens import tokenizer_path

    return np.array([*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_packing(spark):
    rows = [(i + 1000, t) for i, t in texts(80, 8)] + EDGES + [(600, "an <|endoftext|> inside"), (601, "w " * 9000)]
    got = pack(frame(spark, [(*r, 1) for r in rows], DOC + ", offset int").repartition(3)).collect()
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at & (at - 1) == 0
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain_ids("byte_bpe_50k.json", t))
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        texts_of = want[i]
        assert len(set(texts_of)) == 1  # the row that stands twice
        whole, seen = texts_of[0], Counter()
        for r in parts:
            assert r.doc_tokens == len(whole) // 4 and zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
            seen.update(range(r.start, r.start + r.length))
        assert seen == dict.fromkeys(range(len(whole) // 4), len(texts_of))
    assert pack(frame(spark, [])).count() == 0


def test_dac_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for top in (1, 200, 50_000, 1 << 31):
        ids = rng.integers(0, top, 3000).astype("<u4")
        data = dac_encode(ids, np.array([10, 3000]), np.array([4, 9]), 2, 3, 70) + b"\n"
        reads = []
        file = TokenFile(lambda at, n: reads.append(n) or data[at : at + n], len(data))  # noqa: B023
        assert (file.part, file.shard, file.first, file.n) == (2, 3, 70, 3000)
        for i in range(0, 3000, 97):
            reads.clear()
            assert file[i] == ids[i] and len(reads) <= 4 and max(reads) < 600
        assert (file.all() == ids).all() and [x.tolist() for x in file.documents()] == [[4, 9], [10, 3000]]
    none = TokenFile.of(dac_encode(np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)) + b"\n")
    assert none.all().tolist() == []


def test_token_files(spark, tmp_path):
    from quillstone.llm.token_output import token_index, write_tokens
    from quillstone.llm.tokens import tokenizer_path

    rows = texts(60, 9) + [(500, None), (501, ""), (502, "an <|endoftext|> inside"), (None, "no id"), (None, None)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files(frame(spark, rows).repartition(4)).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, order):
        if i is None:
            at = r.start + r.n_tokens
            continue
        ids = plain_ids("word_bpe_49k.json", t)
        assert tuple(r) == (i, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    nameless = sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id is None)
    assert nameless == sorted((len(x) // 4, zlib.crc32(x)) for x in (plain_ids("word_bpe_49k.json", t) for i, t in rows if i is None))
    # any id by its place from the written files, without reading them whole
    write_tokens(frame(spark, rows), str(tmp_path / "ids"), tokenizer_path("word_bpe_49k.json"), True, 200)
    index = sorted(token_index(spark, str(tmp_path / "ids")).collect(), key=lambda r: (r.part, r.shard))
    want = np.concatenate([np.frombuffer(plain_ids("word_bpe_49k.json", t), "<u4") for i, t in order if i is not None])
    skip, place = sum(n for n, _ in nameless), 0
    assert len(index) > 3
    for r in index:
        file = TokenFile.open(spark, r.path)
        for i in range(0, r.n_ids, 37):
            if place + i >= skip:
                assert file[i] == want[place + i - skip]
        place += r.n_ids
    assert token_files(frame(spark, [])).count() == 0
    assert token_files(frame(spark, EDGES)).count() == len(EDGES)


# --- licences


def test_license_join_is_exact():
    rng = random.Random(7)
    words = "a b c d e f g h i j k l m n o p".split()
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randint(2, 9)))) for i in range(12)]
    index = Templates(templates, {w.encode(): rng.randint(0, 9) for w in words}, 0.7)
    for _ in range(500):
        block = rng.choices(words, k=rng.randint(0, 14))
        want = sorted((n, len({*t.split()} & {*block}) / len({*t.split()})) for n, t in templates if len({*t.split()} & {*block}) >= math.ceil(0.7 * len({*t.split()}) - 1e-9))
        assert sorted(index.matches([w.encode() for w in block])) == want


def test_license_query_is_that_of_brute_force(spark):
    from quillstone.llm.license_scan import CONTAINMENT, PHRASES, TEMPLATES

    rng, rows = random.Random(9), []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(TEMPLATES)[1].split()
            part = [w for w in part if rng.random() > rng.choice([0, 0.15, 0.3])]
            words += rng.choices(["x", "mit license", "Apache License", "license", "the", "Żółć"], k=rng.randint(0, 6)) + part
        rows.append((i, " ".join(w + rng.choice(["", "", "\n"]) for w in words)))
    got = {r.doc_id: r for r in scan(frame(spark, rows + [(None, None)])).collect()}
    for i, text in rows:
        words = alnum_words(text.encode())
        starts, base, labels, score = [], set(), set(), 0.0
        for phrase, label in PHRASES.items():
            p = phrase.encode().split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            starts += found
            base |= {label} if found else set()
        for label, t in TEMPLATES:
            t = alnum_words(t.encode())
            width = math.ceil(len(t) / CONTAINMENT)
            blocks = [alnum_words(x.encode()) for x in text.split("\n")] + [words[k : k + width] for k in range(len(words))]
            share = max(len({*t} & {*b}) / len({*t}) for b in blocks)
            if share >= CONTAINMENT - 1e-12:
                labels.add(label)
                score = max(score, share)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert (r.base_labels, r.labels, r.score) == (",".join(sorted(base)), ",".join(sorted(base | labels)), pytest.approx(score))


def test_license_scan(spark):
    rows = [(1, "See the MIT\nLicense. mit-license"), (2, "x\nThis work is licensed under the GNU General Public License, version 3."), (3, None), (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that following conditions are met")]
    got = {r.doc_id: r for r in scan(frame(spark, [(*r, "z") for r in rows], DOC + ", labels string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (6, 2, 2, 4, "mit", "mit")
    assert (got[2].base_labels, got[2].labels, got[2].score, got[2].blocks) == ("gpl", "gpl", 1.0, 1)
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert got[4].labels == "bsd" and got[4].base_labels == "" and got[4].score >= 0.8
    assert scan(frame(spark, [])).count() == 0 and scan(frame(spark, EDGES)).count() == len(EDGES)


# --- decontamination


def test_license_notices_wrapped_over_lines(spark):
    import textwrap

    from quillstone.llm.license_scan import TEMPLATES

    rows, want = [], {}
    for k, label in enumerate(("mit", "bsd", "lgpl", "isc", "mpl")):
        text = max((t for lab, t in TEMPLATES if lab == label), key=len)
        rows.append((k, "Head of a file\n" + "\n".join(" * " + x for x in textwrap.wrap(text, 45)) + "\nint main"))
        want[k] = label
    rows.append((9, "Redistribution and use\nof nothing else in source"))
    got = {r.doc_id: r for r in scan(frame(spark, rows)).collect()}
    for k, label in want.items():
        assert label in got[k].labels.split(",") and got[k].score == 1.0 and got[k].blocks == 1
    assert (got[9].labels, got[9].score, got[9].blocks) == ("", 0.0, 0)


def brute_overlaps(text, item):
    """The most equal words of a stretch, at least 3 of 4 equal, on a diagonal where a mask's words agree."""
    from quillstone.llm.decontamination import MASKS

    best = 0
    for shift in range(-len(item) + 1, len(text)):
        same = [text[k] == item[k - shift] for k in range(max(0, shift), min(len(text), shift + len(item)))]
        if any(all(same[k + j] for j, c in enumerate(m) if c == "1") for m in MASKS for k in range(len(same) - len(m) + 1)):
            for b in range(len(same)):
                for e in range(b + 1, len(same) + 1):
                    n = sum(same[b:e])
                    if 4 * n >= 3 * (e - b):
                        best = max(best, n)
    return best if best >= min(12, math.ceil(0.8 * len(item))) else 0


def test_decontamination_is_that_of_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    items = [rng.choices(words, k=rng.choice([4, 9, 30])) for _ in range(8)]
    rows = []
    for i in range(60):
        part = list(rng.choice(items))
        cut = rng.randint(0, len(part) // 2)
        part = part[cut : cut + rng.randint(8, 30)]
        part = [w if rng.random() > rng.choice([0, 0.1, 0.25, 0.3]) else "other" for w in part]
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 9)) + part + rng.choices(words, k=rng.randint(0, 9)))))
    rows.append((90, " ".join(items[2][:11] + ["a"] * 4 + items[2][15:])))
    bench = frame(spark, list(enumerate(map(" ".join, items))), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in find_leaks(frame(spark, rows), bench).collect()}
    want = {(i, k): n for i, t in rows for k, item in enumerate(items) if (n := brute_overlaps(t.split(), item))}
    assert got == want and len(want) > 20


def test_decontamination(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    item = rng.choices(words, k=40)
    changed = [w if k % 6 else "zzz" for k, w in enumerate(item)]
    fill = lambda: rng.choices(words, k=50)
    rows = [(1, " ".join(fill() + item + fill())), (2, " ".join(fill() + changed + fill()).upper()), (3, " ".join(fill())), (4, None), (5, ""), (6, ", ".join(item[5:22])), (7, " ".join(item[:6] + fill()))]
    bench = frame(spark, [(9, " ".join(item)), (10, "too short"), (11, None), (12, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.n_matched for r in find_leaks(frame(spark, rows), bench).collect()}
    assert set(found) == {(1, 9), (2, 9), (6, 9)} and found[1, 9] == 40
    again = find_leaks(frame(spark, rows), bench, index_words=1)
    assert {(r.doc_id, r.item_id) for r in again.collect()} == set(found)
    kept = decontaminated(frame(spark, [(*r, "k") for r in rows], DOC + ", item_id string"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7] and kept.columns == ["doc_id", "text", "item_id"]
    assert find_leaks(frame(spark, []), bench).count() == 0 and find_leaks(frame(spark, EDGES), bench.limit(0)).count() == 0


# --- quality


def test_bradley_terry_learns_the_order():
    x = np.random.default_rng(2).normal(size=(600, 4))
    strength = x @ [2, -1, 0, 0.5]
    mean, scale, w = bradley_terry(x, (strength > 0.3).astype(int))
    assert np.corrcoef((x - mean) / scale @ w, strength)[0, 1] > 0.97


def test_quality(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choices(["tree", "house", "runs", "over", "the"], k=30)) + ".") for i in range(120)]
    bad = [(i + 200, " ".join(x + "%%%" for x in rng.choices("abcdefg", k=30))) for i in range(120)]
    docs = frame(spark, [(*r, 5) for r in good + bad + [(900, None), (901, "")]], DOC + ", score int")
    labels = frame(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(got) == 242 and all(got[i].predicted == 1 for i, _ in good) and all(got[i].predicted == 0 for i, _ in bad)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    nobody = frame(spark, [(None, "x", 1), (None, None, 2)], DOC + ", held_out int")
    assert [(r.held_out, r.score) for r in quality(nobody, labels).collect()] == [(False, 0.5)] * 2
    disagreeing = labels.union(frame(spark, [(i, 1 - (i < 200), 0) for i, _ in good + bad], labels.schema))
    assert fit(docs, disagreeing) is None
    assert fit(docs, labels.limit(0)) is None and scored(docs, None).filter("predicted = 1").count() == 242
    assert quality(docs.limit(0), labels).count() == 0


def test_every_labelled_row_teaches(spark):
    """Rows beyond one block count too: without those that any one hash would pick last, or first, the model is another."""
    rng = random.Random(4)
    docs = frame(spark, [(i, " ".join(rng.choices(["tree", "house", "a%", "b9", "The"], k=rng.randint(3, 40)))) for i in range(300)])
    of = lambda rows: frame(spark, [(i, int(i % 2), 0) for i in rows], "doc_id long, quality int, toxic int")
    order = [r.id for r in spark.range(300).filter("crc32(CAST(CAST(id AS STRING) AS BINARY)) % 3 <> 1").orderBy(F.xxhash64("id")).collect()]
    flat = lambda m: np.concatenate([*m[:3], [m[3]]])
    full = flat(fit(docs, of(range(300)), 40))
    for some in (order[:-30], order[30:]):
        assert not np.allclose(full, flat(fit(docs, of(some), 40)), rtol=1e-9)
    # more blocks than one find about the weights of one regression
    one = flat(fit(docs, of(range(300))))
    assert np.allclose(full[:36], one[:36]) and np.isfinite(full).all()


def test_cut_of_counts():
    bins, good, bad = np.array([0, 2, 5, 9]), np.array([0, 1, 40, 60]), np.array([50, 30, 1, 0])
    assert cut(-1.0, 0.5, bins, good, bad) == -1.0 + 0.5 * 4
    assert cut(3.0, 1.0, bins[:1], good[2:3], bad[2:3]) == 3.0


def test_words():
    assert alnum_words("A-b é1\x00C".encode()) == [b"a", b"b", "é1".encode(), b"c"]


# --- the pipeline


def test_pipeline_stages_keep_what_they_should(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        before = {(r.doc_id, r.text) for r in docs.collect()}
        rows = out.collect()
        after = {(r.doc_id, r.text) for r in rows}
        assert after <= before and after
        if name == "exact_dedup":
            lower = lambda t: (t or "").encode().lower()
            assert {lower(t) for _, t in before} == {lower(t) for _, t in after} and len({lower(t) for _, t in after}) == len(after)
        if name == "near_dedup":
            want = brute_components(before)
            assert {i for i, _ in after} == {i for i, (_, c) in want.items() if c == i}
        docs = frame(spark, rows, out.schema)
    pieces = cp.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
