"""Every query against its SQL in DuckDB, and the same under another partitioning."""

import datetime
import decimal
import math

import duckdb
import pytest

from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and v == int(v):
        return int(v)
    return str(v) if isinstance(v, datetime.date) else v


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert got.columns and got.count() >= 0
        return
    cursor = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(plain(r[names.index(n)]) for n in sorted(names))) for r in cursor.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got) == want


@pytest.mark.parametrize("name", ["screen_growth", "bm25_topk", "trend_streaks", "near_dup_fold", "unit_merge", "rrf_fusion"])
def test_partitioning_changes_nothing(spark, name):
    first = rows_of(catalog.QUERIES[name](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of(catalog.QUERIES[name](spark, SF)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["company", "period", "growth"]
    assert set(e.oracle_sql()) <= set(e.queries())
