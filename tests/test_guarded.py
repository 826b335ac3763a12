"""Guarded writes: refused and accepted runs, what stays current, and registries with a shared table."""

import pytest
from pyspark.sql import functions as F

from quillstone.sources import guarded as g
from quillstone.sources import sinks

DDL = "id int, text string, note string"
OLD = [(1, "a", "x"), (2, "b", None), (3, None, "y")]


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.swap_version(spark.createDataFrame(OLD, DDL), root, "v1")
    return root


def refused(spark, root, rows, version, rules=()):
    with pytest.raises(g.Refused) as e:
        g.overwrite_metadata(spark.createDataFrame(rows, DDL), root, version, "id", "text", rules)
    assert sorted(r.id for r in sinks.current(spark, root).collect()) == [1, 2, 3]
    assert sinks.current(spark, root).filter("id = 1").first().note == "x"
    return e.value.reason


def test_only_metadata_may_change(spark, store):
    rules = [("id", F.col("id") > 0), ("note", F.coalesce(F.length("note") < 5, F.lit(True)))]
    assert refused(spark, store, [(1, "a", "longer"), (2, "b", ""), (3, None, "")], "v2", rules) == "invalid"
    assert refused(spark, store, OLD[:2], "v3") == refused(spark, store, [*OLD, (4, "d", "")], "v4") == "ids_differ"
    assert refused(spark, store, [*OLD, OLD[0]], "v5") == "repeated_ids"
    assert refused(spark, store, [(1, "A", "x"), *OLD[1:]], "v6") == "texts_differ"
    assert refused(spark, store, [*OLD[:2], (3, "", "y")], "v7") == "texts_differ"
    n = g.overwrite_metadata(spark.createDataFrame([(1, "a", "new"), (2, "b", "z"), (3, None, "y")], DDL), store, "v8", "id", "text", rules)
    assert n == {"both": 3, "only_old": 0, "only_new": 0, "repeated": 0, "texts": 0, "fields": 2}
    assert sinks.current(spark, store).filter("id = 1").first().note == "new"


def test_changes_with_columns_of_one_side(spark):
    old, new = spark.createDataFrame(OLD, DDL), spark.createDataFrame([(1, "a", "x", 5), (2, "b", None, None)], DDL + ", more int")
    assert g.changes(old, new, "id", "text").first().asDict() == {"both": 2, "only_old": 1, "only_new": 0, "repeated": 0, "texts": 0, "fields": 1}
    assert g.changes(old.limit(0), old.limit(0), "id", "text").first().both == 0


def test_aliases_are_used_once_each(spark):
    rows = spark.createDataFrame([("s", "n"), ("t", "n。"), ("u", None), ("v", None)], "id string, notes string")
    alias = lambda *a: spark.createDataFrame(list(a), "id string, alias string")
    out = g.with_aliases(rows, alias(("s", "x"), ("t", "y"), ("u", "z")), "id", "notes")
    assert {r.id: r.notes for r in out.collect()} == {"s": "n。x", "t": "n。y", "u": "z", "v": None}
    for bad, reason in (([("w", "x")], "unused_aliases"), ([("s", "x"), ("s", "y")], "repeated_aliases")):
        with pytest.raises(g.Refused) as e:
            g.with_aliases(rows, alias(*bad), "id", "notes")
        assert e.value.reason == reason and e.value.counts == {"keys": [bad[0][0]]}


def test_registry_and_its_shared_table_belong_together(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", ""), (3, "b", None), (4, None, "x")], "id int, p string, q string")
    root = str(tmp_path / "r")
    path = g.write_registry(rows, root, "v1", ["p", "q"], [("id", F.col("id") > 0)])
    assert sorted(map(str, g.read_registry(spark, root, ["p", "q"]).select("id", "p", "q").collect())) == sorted(map(str, rows.collect()))
    assert {(r.column, r.number, r.value) for r in spark.read.parquet(f"{path}/shared").collect()} == {("p", 0, "a"), ("p", 1, "b"), ("q", 0, "x")}
    spark.createDataFrame([("p", 0, "other")], "column string, number int, value string").write.mode("overwrite").parquet(f"{path}/shared")
    with pytest.raises(g.Refused, match="pair_differs"):
        g.read_registry(spark, root, ["p", "q"])
    with pytest.raises(g.Refused, match="invalid"):
        g.write_registry(rows, root, "v2", ["p"], [("id", F.col("id") > 1)])
    monkeypatch.setattr(g, "DICTIONARY", 2)
    with pytest.raises(g.Refused, match="too_many_values"):
        g.factored(rows, ["p", "q"])
