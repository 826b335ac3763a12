"""Retrieval and text-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import checks, chunking, curation
from quillstone.operators import retrieval as rt
from quillstone.plans.adapters import CHUNKS, chunks, table
from quillstone.plans.catalog import query
from quillstone.sources.formats import html_anchors, html_cells, html_text, status_of
from quillstone.sources.shared import stored, tasks_for

PUBLIC = ["public"]
TOK = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"
STATS = f"""{CHUNKS}, pub AS (SELECT * FROM ch WHERE layer = 'public'), tk AS (SELECT id, org, unnest({TOK}) AS term FROM pub), dl AS (SELECT id, len({TOK}) AS dl FROM pub), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
    tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
    idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
QT = rf"""qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY 1, 2),
    bs AS (SELECT query_id, tf.id, round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.id = tf.id, st GROUP BY 1, 2),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= 10)"""
CTE = f"{STATS}, {QT}"


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _public(spark, sf):
    return rt.search_filter(chunks(spark, sf), PUBLIC)


def _ranked(spark, sf, k=10):
    return rt.bm25(_queries(spark, sf), _public(spark, sf), k)


@query(f"WITH {STATS} SELECT n_docs, round(avgdl, 6) AS avgdl FROM st")
def bm25_stats(spark, sf):
    return rt.corpus_stats(_public(spark, sf)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {STATS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf):
    p = _public(spark, sf)
    return rt.idf(rt.postings(p), rt.corpus_stats(p)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {CTE} SELECT query_id, id, round(score, 4) AS score, rank FROM bm")
def bm25_topk(spark, sf):
    return _ranked(spark, sf).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def _dense(spark, sf, k=10):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return rt.dense(q, v, k)


DENSE = """dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE rank <= 10)"""


@query(f"WITH {DENSE} SELECT query_id, id, score, rank FROM dn")
def dense_topk(spark, sf):
    return _dense(spark, sf)


FUSE = "al AS (SELECT query_id, id, rank, 0 AS l FROM bm UNION ALL SELECT query_id, id, rank, 1 FROM dn), fu AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score, min(l * 1000 + rank) AS seen FROM al GROUP BY 1, 2)"


@query(f"WITH {CTE}, {DENSE}, {FUSE} SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM fu")
def rrf_fusion(spark, sf):
    return rt.fused([_ranked(spark, sf), _dense(spark, sf)]).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {CTE}, {DENSE}, al AS (SELECT query_id, id, rank * 10 AS turn FROM bm UNION ALL SELECT query_id, id, rank * 10 + 1 FROM dn), g AS (SELECT query_id, id, min(turn) AS turn FROM al GROUP BY 1, 2) SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS rank FROM g) WHERE rank <= 12")
def interleave_pools(spark, sf):
    return rt.interleaved([_ranked(spark, sf), _dense(spark, sf)], 12)


ORGS = ["src1", "src2", "src3"]
PAIRS = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"""WITH {CTE.replace("WHERE layer = 'public'", "WHERE layer = 'public' AND org IN ('src1', 'src2', 'src3') AND size BETWEEN 100 AND 5000")},
    dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM (SELECT * FROM {PAIRS} WHERE id IN (SELECT item_id FROM benchmark)) q, {PAIRS} v WHERE v.id IN (SELECT id FROM pub)) QUALIFY rank <= 10), {{FUSE}}
    SELECT * FROM (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM fu) WHERE rank <= 10""".replace("{FUSE}", FUSE))
def hybrid_filtered(spark, sf):
    """Word and vector search under one filter, fused; chunk and item i have vector i."""
    pool = rt.search_filter(chunks(spark, sf).withColumn("date_int", F.col("size")), PUBLIC, ORGS, 100, 5000)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    items = _queries(spark, sf)
    q = v.join(items, F.col("id") == F.col("query_id"), "left_semi").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    out = rt.fused([rt.bm25(items, pool, 10), rt.dense(q, v.join(pool.select("id"), "id", "left_semi"), 10)])
    return out.filter("rank <= 10").select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 'public' ELSE 'restricted' END AS layer, count(*) AS n FROM documents GROUP BY 1")
def layer_guard(spark, sf):
    try:
        rt.require_layer(chunks(spark, sf), [])
    except rt.LayerError:
        pass
    else:
        raise AssertionError("a search without a layer went through")
    return chunks(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"WITH {CTE} SELECT * FROM (SELECT query_id, id, rank, org, count(*) OVER (PARTITION BY query_id, org) - 1 AS same_doc_hits, row_number() OVER (PARTITION BY query_id, org ORDER BY rank) AS n FROM bm JOIN (SELECT id, org FROM pub) p USING (id)) WHERE n = 1")
def diversify_docs(spark, sf):
    r = _ranked(spark, sf).join(_public(spark, sf).select("id", "org"), "id")
    return rt.diversified(r, "org").select("query_id", "id", "rank", "org", "same_doc_hits", F.lit(1).alias("n"))


@query(f"WITH {CTE} SELECT query_id, id, rank, org FROM (SELECT *, row_number() OVER (PARTITION BY query_id, org ORDER BY rank) AS n FROM bm JOIN (SELECT id, org FROM pub) p USING (id)) WHERE n <= 2")
def per_doc_cap(spark, sf):
    r = _ranked(spark, sf).join(_public(spark, sf).select("id", "org"), "id")
    return rt.capped(r, "org", 2).select("query_id", "id", "rank", "org")


LANGS = f"WITH {CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, id) AS rank FROM (SELECT bs.*, lang FROM bs JOIN (SELECT id, lang FROM pub) p USING (id)) QUALIFY rank <= 5)"


def _by_lang(spark, sf):
    pool = _public(spark, sf)
    return rt.bm25_by(_queries(spark, sf), pool.select("id", "text", "lang"), "lang", 5)


@query(f"{LANGS}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id, lang) AS best FROM r WHERE rank <= 3), u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, best DESC, lang) AS merged FROM t) SELECT query_id, id, lang, merged FROM u WHERE merged <= 8")
def coverage_fanout(spark, sf):
    """Each language is searched by itself, so that none crowds out another."""
    return rt.round_robin(_by_lang(spark, sf), "lang", 3, 8).select("query_id", "id", "lang", "merged")


ONLY, FIRST = ["the", " la "], ["que", "nde"]
HAS = lambda words: "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


@query(f"""{LANGS}, h AS (SELECT r.*, size AS day FROM r JOIN (SELECT id, size FROM pub) p USING (id) WHERE score >= 20), e AS (SELECT query_id, lang, max(score) AS top FROM h GROUP BY 1, 2), c AS (SELECT query_id, count(*) AS n, arg_max(lang, top) AS best FROM e GROUP BY 1)
    SELECT item_id AS query_id, coalesce(n, 0) AS covering, CASE WHEN n = 1 AND ({HAS(ONLY)} OR NOT {HAS(FIRST)}) THEN 'resolve' ELSE 'abstain' END AS decision, CASE WHEN n = 1 AND ({HAS(ONLY)} OR NOT {HAS(FIRST)}) THEN best END AS answer FROM benchmark LEFT JOIN c ON query_id = item_id""")
def aggregation_scan(spark, sf):
    hits = _by_lang(spark, sf).join(_public(spark, sf).select("id", F.col("size").alias("day")), "id")
    return rt.decided(_queries(spark, sf), rt.group_evidence(hits, "lang", "day", 20), "lang", ONLY, FIRST)


@query(f"""{LANGS}, h AS (SELECT r.*, size AS day FROM r JOIN (SELECT id, size FROM pub) p USING (id) WHERE score >= 20) SELECT query_id, lang, count(*) AS hits, arg_min(id, rank) AS best_id, min(day) AS earliest, arg_min(id, (day, rank)) AS earliest_id FROM h GROUP BY 1, 2""")
def group_evidence(spark, sf):
    hits = _by_lang(spark, sf).join(_public(spark, sf).select("id", F.col("size").alias("day")), "id")
    return rt.group_evidence(hits, "lang", "day", 20).select("query_id", "lang", "hits", "best_id", "earliest", "earliest_id")


HOLDS = "gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))"


def _gold(spark, sf):
    return rt.containing(_queries(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {HOLDS} SELECT query_id, id FROM gold")
def containment_join(spark, sf):
    return _gold(spark, sf)


@query(f"WITH {CTE}, {HOLDS}, g AS (SELECT query_id, id FROM gold WHERE id IN (SELECT id FROM pub)), h AS (SELECT query_id, min(rank) AS r FROM (SELECT DISTINCT query_id FROM g) LEFT JOIN (SELECT bm.query_id AS q, rank FROM bm JOIN g ON g.query_id = bm.query_id AND g.id = bm.id) ON q = query_id GROUP BY 1) SELECT count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM h")
def retrieval_metrics(spark, sf):
    gold = _gold(spark, sf).join(_public(spark, sf).select("id"), "id", "left_semi")
    return rt.hit_metrics(_ranked(spark, sf), gold)


@query(f"""WITH {CTE}, t AS (SELECT id, regexp_replace(text, '\\s', '', 'g') AS t FROM pub WHERE id IN (SELECT id FROM bm)), s AS (SELECT id, list_distinct(CASE WHEN length(t) < 5 THEN [t] ELSE [substr(t, i, 5) FOR i IN range(1, length(t) - 3)] END) AS s FROM t),
    sh AS MATERIALIZED (SELECT id, unnest(s) AS s FROM s), hits AS MATERIALIZED (SELECT query_id, id FROM bm), k AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM hits x JOIN hits y ON x.query_id = y.query_id AND x.id < y.id),
    c AS (SELECT id, count(*) AS c FROM sh GROUP BY 1), o AS (SELECT a, b, count(*) AS n FROM k JOIN sh u ON u.id = a JOIN sh v ON v.id = b AND v.s = u.s GROUP BY 1, 2), p AS (SELECT a, b, n, x.c AS x, y.c AS y FROM o JOIN c x ON x.id = a JOIN c y ON y.id = b),
    f AS MATERIALIZED (SELECT a, b, round(n / (x + y - n), 6) AS jaccard, round(n / least(x, y), 6) AS containment FROM p WHERE round(n / (x + y - n), 6) >= 0.8 OR round(n / least(x, y), 6) >= 0.9)
    SELECT x.query_id, a, b, jaccard, containment FROM f JOIN hits x ON x.id = a JOIN hits y ON y.id = b AND y.query_id = x.query_id""")
def near_dup_pairs(spark, sf):
    """Near pairs among each query's hits, as they are shown together."""
    hits = _ranked(spark, sf).join(_public(spark, sf).select("id", "text"), "id")
    return rt.near_pairs(hits)


@query()
def near_dup_fold(spark, sf):
    r = _ranked(spark, sf).join(_public(spark, sf).select("id", "text", F.col("lang").alias("series"), F.col("size").alias("version")), "id")
    return rt.folded(r.select("query_id", "id", "rank", "series", "version", "text")).withColumn("older", F.array_join(F.transform("older", lambda x: x.cast("string")), ","))


@query("SELECT doc_id, CAST(greatest(ceil((length(text) - 100) / 700.0), 1) AS INTEGER) AS n_chunks, length(substr(text, CAST((greatest(ceil((length(text) - 100) / 700.0), 1) - 1) * 700 + 1 AS BIGINT), 800)) AS last_length FROM documents")
def chunk_fixed(spark, sf):
    c = tx.fixed_chunks(F.col("text"), 800, 100)
    return table(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", F.size("c").alias("n_chunks"), F.length(F.element_at("c", -1)).cast("long").alias("last_length"))


@query("WITH s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([。！？])', '\\1\n', 'g'), chr(10))) AS s FROM conversations) SELECT conv_id, turn, count(*) FILTER (trim(s) <> '') AS n_sentences FROM s GROUP BY 1, 2")
def sentence_split(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query()
def unit_split(spark, sf):
    parts = tx.bounded_parts(tx.sentences(F.col("text"), ".!?。！？"), 600)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("part", "text")).select("conv_id", "turn", "part", F.length("text").alias("n_chars"))


@query()
def unit_merge(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", "role", "turn", F.posexplode(tx.sentences(F.col("text"), ".!?。！？")).alias("n", "text")).withColumn("order", F.col("turn") * 10000 + F.col("n"))
    return curation.merged_units(s, ["conv_id"], "order", "role", 600).select("conv_id", "island", "role", "part", F.length("text").alias("n_chars"))


@query("SELECT conv_id, CASE WHEN bool_or(contains(text, '?')) THEN 'verbatim' WHEN count(*) FILTER (role = 'user') * 2 >= count(*) THEN 'named' ELSE 'anonymous' END AS kind FROM conversations GROUP BY 1")
def record_type(spark, sf):
    mode = F.when(F.contains("text", F.lit("?")), "verbatim").when(F.col("role") == "user", "named").otherwise("anonymous")
    return curation.record_kind(table(spark, sf, "conversations").withColumn("mode", mode), ["conv_id"])


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedupe_pages(spark, sf):
    return curation.first_copies(table(spark, sf, "documents"), "text", ["doc_id"])


@query("SELECT source, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE regexp_matches(text, '[Ll]icense') GROUP BY 1")
def first_occurrence(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").rlike("[Ll]icense")).groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query()
def html_articles(spark, sf):
    p = table(spark, sf, "pages").select("page_id", html_text("html").alias("text"))
    return p.select("page_id", "text", status_of(F.col("text")).alias("status"))


@query()
def anchors(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(html_anchors("html")).alias("n", "a")).select("page_id", "n", "a.href", "a.label")


@query()
def table_grid(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(html_cells("html")).alias("c")).select("page_id", "c.*")


@query("SELECT lang, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, max(length(text)) AS most FROM documents GROUP BY 1")
def text_length_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(F.length("text")), 6).alias("mean"), F.percentile(F.length("text"), 0.5).alias("median"), F.max(F.length("text")).cast("long").alias("most"))


@query("SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang' END, CASE WHEN n_chars <> length(text) THEN 'n_chars' END], lambda x: x IS NOT NULL)) AS violation FROM documents) GROUP BY 1")
def metadata_audit(spark, sf):
    return checks.audit(table(spark, sf, "documents"), [("short", F.length("text") >= 100), ("lang", F.col("lang").isin("en", "de")), ("n_chars", F.col("n_chars") == F.length("text"))])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_anti_join(spark, sf):
    return curation.not_yet(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT DISTINCT c_name FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey < 3) AND NOT EXISTS (SELECT 1 FROM supplier WHERE starts_with(replace(s_name, 'Supplier', 'Customer') || '_', c_name || '_'))")
def new_by_prefix(spark, sf):
    c = table(spark, sf, "customer")
    fresh = curation.not_yet(c, c.filter("c_custkey < 3"), "c_mktsegment").select("c_name").distinct()
    old = table(spark, sf, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("c_name"))
    return curation.not_yet_by_prefix(fresh, old, "c_name")


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS units, count(*) FILTER (role = 'user') AS user_units FROM conversations GROUP BY 1")
def meeting_coverage(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("units"), F.count_if(F.col("role") == "user").alias("user_units"))


@query("SELECT source, max(doc_id) AS latest, sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 1 ELSE 0 END) AS n_public FROM documents GROUP BY 1")
def freshness_by_group(spark, sf):
    return chunks(spark, sf).groupBy(F.col("org").alias("source")).agg(F.max("id").alias("latest"), F.count_if(F.col("layer") == "public").alias("n_public"))


NAMES = {"one": ["the", "then the"], "two": ["ción", "ci"], "three": ["ent"], "four": ["ein"]}
COUNTING, COVERING = ["qu", "ea"], ["sch"]
MASKED = """m1 AS (SELECT item_id, text, instr(text, 'then the') AS p1, replace(text, 'then the', '########') AS t1 FROM benchmark), m2 AS (SELECT *, instr(t1, 'ción') AS p2, replace(t1, 'ción', '####') AS t2 FROM m1),
    m3 AS (SELECT *, instr(t2, 'the') AS p3, replace(t2, 'the', '###') AS t3 FROM m2), m4 AS (SELECT *, instr(t3, 'ent') AS p4, replace(t3, 'ent', '###') AS t4 FROM m3), m5 AS (SELECT *, instr(t4, 'ein') AS p5, replace(t4, 'ein', '###') AS t5 FROM m4), m6 AS (SELECT *, instr(t5, 'ci') AS p6 FROM m5),
    u AS (SELECT item_id, unnest([{'p': p1, 'g': 'one'}, {'p': p3, 'g': 'one'}, {'p': p2, 'g': 'two'}, {'p': p6, 'g': 'two'}, {'p': p4, 'g': 'three'}, {'p': p5, 'g': 'four'}]) AS s FROM m6),
    g AS (SELECT item_id, s.g AS g, min(s.p) AS p FROM u WHERE s.p > 0 GROUP BY 1, 2), named AS (SELECT item_id, string_agg(g, ',' ORDER BY p) AS named, count(*) AS n FROM g GROUP BY 1)"""


@query(f"WITH {MASKED} SELECT b.item_id, coalesce(named, '') AS named FROM benchmark b LEFT JOIN named USING (item_id)")
def mention_detect(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(tx.mentioned(F.col("text"), NAMES), ",").alias("named"))


@query(f"WITH {MASKED}, k AS (SELECT b.item_id, text, CASE WHEN {HAS(COVERING)} THEN 0 ELSE coalesce(n, 0) END AS n FROM benchmark b LEFT JOIN named USING (item_id)) SELECT item_id, CASE WHEN n = 1 THEN 'targeted' WHEN {HAS(COUNTING)} THEN 'aggregation' WHEN {HAS(COVERING)} OR n >= 2 THEN 'coverage' ELSE 'baseline' END AS strategy FROM k")
def strategy_classifier(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", rt.strategy(F.col("text"), NAMES, COUNTING, COVERING).alias("strategy"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS head FROM documents")
def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.shortened(F.col("text"), 80).alias("head"))


#: Characters of a semantic chunk, at most.
CHUNK = 1500
#: Documents whose sentences, with their vectors, are in one task.
TASK_DOCUMENTS = 10_000


@query(
    f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings),
    l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ss FROM documents),
    s AS (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS t FROM l),
    v AS (SELECT s.*, CAST(embedding AS DOUBLE[]) AS vec FROM s, n JOIN embeddings ON vec_id = (doc_id * 7 + i) % n.n),
    d AS (SELECT doc_id, i, t, round(1 - list_sum(list_transform(range(1, len(vec) + 1), lambda k: vec[k] * after[k])) / (sqrt(list_sum([x * x FOR x IN vec])) * sqrt(list_sum([x * x FOR x IN after]))), 9) AS distance
        FROM (SELECT *, lead(vec) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM v)),
    q AS (SELECT *, quantile_cont(distance, 0.95) OVER (PARTITION BY doc_id) AS most FROM d),
    c AS (SELECT *, CAST(coalesce(sum(CASE WHEN distance > most + 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk FROM q),
    p AS (SELECT doc_id, chunk, i, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY i, k) AS r, length(substr(t, CAST(k * {CHUNK} + 1 AS BIGINT), {CHUNK})) AS size FROM (SELECT *, unnest(range(CAST(ceil(length(t) / {CHUNK}) AS BIGINT))) AS k FROM c)),
    f AS (SELECT doc_id, chunk, r, 0 AS part, size FROM p WHERE r = 1
        UNION ALL SELECT p.doc_id, p.chunk, p.r, CASE WHEN f.size + p.size + 1 <= {CHUNK} THEN f.part ELSE f.part + 1 END, CASE WHEN f.size + p.size + 1 <= {CHUNK} THEN f.size + p.size + 1 ELSE p.size END FROM f JOIN p ON p.doc_id = f.doc_id AND p.chunk = f.chunk AND p.r = f.r + 1),
    e AS (SELECT doc_id, chunk, min(i) AS first, max(i) AS last FROM c GROUP BY 1, 2)
    SELECT f.doc_id, f.chunk, f.part, CAST(max(f.size) AS INTEGER) AS n_chars, CAST(any_value(e.first) AS INTEGER) AS first, CAST(any_value(e.last) AS INTEGER) AS last FROM f JOIN e ON e.doc_id = f.doc_id AND e.chunk = f.chunk GROUP BY 1, 2, 3"""
)
def semantic_chunks(spark, sf):
    """Whole documents; each sentence has a vector of the embeddings by its document and place."""
    vectors, documents = table(spark, sf, "embeddings").select("vec_id", "embedding"), table(spark, sf, "documents")
    n = vectors.count()
    each = documents.select("doc_id", F.posexplode_outer(tx.sentences(F.col("text"), ".!?。！？")).alias("i", "text"))
    found = F.broadcast(vectors) if n <= rt.BROADCAST_ROWS else vectors.hint("shuffle_hash")
    each = each.join(found, (F.col("doc_id") * 7 + F.col("i")) % n == F.col("vec_id")).select("doc_id", "i", "text", "embedding")
    each = each.repartition(tasks_for(documents, TASK_DOCUMENTS), "doc_id")
    return chunking.semantic_chunks(each, "doc_id", "i", "text", "embedding", CHUNK).select("doc_id", "chunk", "part", F.length("text").alias("n_chars"), "first", "last")
