"""Quotes: normal forms, marks and headings, length before order, exactly one unit, and the place as a second way."""

import random

from quillstone.operators import quotes as qt

QUOTE = "quote_id string, path string, lines array<string>, speaker string, page int"
UNIT = "unit_id string, path string, text string, speaker string, page int, end_page int"


def found(spark, quotes, units):
    q, u = spark.createDataFrame(quotes, QUOTE), spark.createDataFrame(units, UNIT)
    return {r.quote_id: (r.unit_id, r.speaker, r.how) for r in qt.find_units(q, u, ["path"]).collect()}


def test_longest_fragment_in_exactly_one_unit(spark):
    units = [("u1", "p", "The budget was ｃｕｔ by a third.", "A", 1, None), ("u2", "p", "The budget was cut by half, and taxes rose.", "B", 1, 2), ("u3", "p", None, "C", 2, None), ("u4", "q", "taxes rose again", "D", 1, None)]
    quotes = [
        ("long", "p", ["○A The budget was", "taxes rose."], "", None), ("norm", "p", ["〇B【委員】The  budget was cut　by half"], "B", None),
        ("twice", "p", ["The budget was cut"], "", None), ("speaker", "p", ["The budget was cut"], "B", 2), ("page", "p", ["short"], "Z", 2), ("path", "q", ["The budget was cut by a third"], "", None), ("empty", "p", [], None, 1), ("null", "p", None, None, None),
    ]
    assert found(spark, quotes, units) == {
        "long": ("u2", "B", "fragment"), "norm": ("u2", "B", "fragment"), "twice": (None, None, "none"), "speaker": ("u2", "B", "speaker_on_page"),
        "page": ("u2", "B／C", "page"), "path": (None, None, "none"), "empty": (None, None, "none"), "null": (None, None, "none"),
    }


def test_forty_characters_are_compared(spark):
    text = "abcdefghij" * 4
    assert found(spark, [("q", "p", [text + "other end"], "", None)], [("u", "p", text + "this end", "A", 1, None)])["q"][0] == "u"
    assert found(spark, [("q", "p", [text], "", None)], [])["q"] == (None, None, "none")


def test_seeds_against_brute_force(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("ab東") for _ in range(n))
    units = [(f"u{i}", "p", text(rnd.choice((5, 60, 300))), "A", 1, None) for i in range(60)]
    needles = {text(n) for n in (10, 11) * 40} | {u[2][k : k + n] for u in units for k, n in ((0, 10), (3, 19), (7, 20), (9, 39), (11, 40)) if len(u[2]) > 60}
    got = {r.needle: (r.n, r.unit_id) for r in qt.needle_hits(spark.createDataFrame([("p", n) for n in needles], "path string, needle string"), spark.createDataFrame(units, UNIT), ["path"]).collect()}
    want = {n: [u[0] for u in units if n in u[2]] for n in needles}
    assert got == {n: (len(h), min(h)) for n, h in want.items() if h} and any(len(h) > 1 for h in want.values())


def test_attribution(spark):
    f = spark.createDataFrame([("a", "u", "Ｋ ono", "fragment", None), ("b", "u", "不明", "fragment", None), ("c", "u", "X", "fragment", None), ("d", "u", "X", "page", None), ("e", "u", "不明", "page", None), ("f", None, None, "none", None)], "quote_id string, unit_id string, speaker string, how string, fragment string")
    labels = spark.createDataFrame([("a", "Kono"), ("b", "K"), ("c", "K"), ("d", None), ("e", None), ("f", "K"), ("g", "K")], "quote_id string, speaker string")
    assert {r.quote_id: r.verdict for r in qt.attribution(f, labels).collect()} == {"a": "ok", "b": "unknown", "c": "wrong", "d": "named_anonymous", "e": "ok", "f": "no_unit", "g": "no_unit"}


def test_seeds_of_many_texts_are_those_of_each(spark):
    """One pass gives all classes, and no window crosses from one text to the next."""
    texts = ["", "abc", "0123456789" * 3, "x" * 25, "äöü" * 20, "0123456789"]
    for width in qt.CLASSES:
        row, seed = qt.window_seeds(texts, width)
        assert sorted(zip(row.tolist(), seed.tolist())) == sorted((i, s) for i, t in enumerate(texts) for s in qt.window_seeds([t], width)[1].tolist())
    units = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "unit_id int, path string, text string")
    got = {(r.unit_id, r.width) for r in qt.seeded(units, ["path"]).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in qt.CLASSES if len(t) >= w}
    # one evaluation in Python for the texts' seeds, whatever the number of classes
    assert qt.seeded(units, ["path"])._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
