"""Word search: each text is cut into words once, rankings are made once, and what comes out."""

from quillstone.operators import retrieval as rt

TEXTS = [(1, "a b c d e", "x"), (2, "b b c, d e f", "y"), (3, "q r s t u", "x"), (4, None, "x"), (5, "", None)]


def rows(spark):
    return spark.createDataFrame([(7, "b c d e"), (8, "zz")], "query_id long, text string"), spark.createDataFrame(TEXTS, "id long, text string, lang string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_into_words_once_and_scores_stay_where_they_are_made(spark):
    queries, chunks = rows(spark)
    ranked = rt.bm25_by(queries, chunks, "lang", 5)
    assert "regexp_extract_all" not in plan(ranked)
    assert ranked._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(query_id") == 1
    assert sorted((r.query_id, r.id, r.lang, r["rank"]) for r in ranked.collect()) == [(7, 1, "x", 1), (7, 2, "y", 1)]


def test_words_are_looked_up_once_and_a_text_is_found_once(spark):
    queries = spark.createDataFrame([(1, "x One two three y"), (2, "two"), (3, "")], "query_id long, text string")
    texts = spark.createDataFrame([(1, "aX ONE two three yb one two three one two three"), (2, "x one, two three y"), (3, None), (4, "")], "id long, text string")
    found = rt.containing(queries, texts)
    assert "transform(" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (2, 2)]


def test_metrics_read_the_gold_rows_once(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 12, 6)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 12), (2, 99), (3, 10)], "query_id long, id long")
    got = rt.hit_metrics(ranked, gold)
    assert plan(got).count("Join") == 1
    assert tuple(got.first()) == (3, 0.0, 0.333333, 0.666667, round((1 / 2 + 1 / 6) / 3, 6))


def test_near_pairs_rank_once(spark):
    queries, _ = rows(spark)
    chunks = spark.createDataFrame([(1, "b c d e f g h i"), (2, "b c d e f g h i j"), (3, "b q r s t u v w")], "id long, text string")
    pairs = rt.near_pairs(rt.bm25(queries, chunks, 5).join(chunks, "id"))
    assert "Window" not in plan(pairs) and "array_distinct" not in plan(pairs)
    assert list(map(tuple, pairs.collect())) == [(7, 1, 2, 0.8, 1.0)]
