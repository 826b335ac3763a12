"""Text retrieval: BM25, exact vector search, rank fusion, diversity, near-duplicate folding and fan-out by group."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import char_shingles, containment, jaccard, mentioned, tokens
from quillstone.sources.shared import stored

#: Saturation, length weight, floor for negative weights, rank constant.
K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60


class LayerError(ValueError):
    """A search without a layer is refused."""


def require_layer(chunks: DataFrame, layers: list[str] | None) -> DataFrame:
    """The chunks of these layers; without layers there is no search."""
    if not layers:
        raise LayerError("a layer is required")
    return chunks.filter(F.col("layer").isin(list(layers)))


def search_filter(chunks: DataFrame, layers: list[str], orgs: list[str] | None = None, since: int | None = None, until: int | None = None, tag: str | None = None) -> DataFrame:
    """All given conditions together; a null date passes no date range. The filter stands before any ranking."""
    out = require_layer(chunks, layers)
    if orgs:
        out = out.filter(F.col("org").isin(list(orgs)))
    if since is not None:
        out = out.filter(F.col("date_int") >= since)
    if until is not None:
        out = out.filter(F.col("date_int") <= until)
    if tag:
        out = out.filter(F.exists("tags", lambda t: F.contains(t, F.lit(tag))))
    return out


def postings(chunks: DataFrame, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """id, term, tf, dl; chunks without terms are left out here, but count in the statistics."""
    words = chunks.select("id", tokenizer(F.col("text")).alias("ts"))
    return words.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(chunks: DataFrame, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """One row: n_docs and avgdl, with the chunks that have no term."""
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce(F.size(tokenizer(F.col("text"))), F.lit(0))).alias("avgdl"))


def idf(post: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """term, df, idf: negative weights become epsilon times the mean over all terms' weights, negative ones included."""
    df = stored(post.groupBy("term").agg(F.count("*").alias("df")), "df")
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Up to so many rows of query terms, or links to texts, are broadcast; beyond, the join is a shuffled one.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """rows with a hint to broadcast them, if a count shows that they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def bm25_scores(queries: DataFrame, chunks: DataFrame, tokenizer: Callable[[Column], Column] = tokens, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, the chunks' columns to keep, score of every chunk that has a query's word; words that the corpus lacks count for nothing.

    Document frequencies are of all chunks; of the chunks' words only those that a query has are counted and shuffled.
    Texts are cut into words once, and the words stored. A chunk's words are in one task, where its scores for all
    queries are made: of these only what a ranking leaves of them moves again.
    """
    q = queries.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    words = stored(chunks.select("id", *keep, tokenizer(F.col("text")).alias("ts")).withColumn("dl", F.size("ts")), "words")
    stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    df = words.select(F.explode(F.array_distinct("ts")).alias("term"))
    weighed = stored(q.join(idf(df, stats), "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("asked")), "weights")
    asked = small(weighed.select("term").distinct())
    tf = words.select("id", *keep, "dl", F.explode("ts").alias("term")).join(asked, "term", "left_semi").groupBy("id", *keep, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    held = tf.repartition("id").crossJoin(F.broadcast(stats)).select("id", *keep, "term", weight.alias("weight"))
    return held.join(small(weighed), "term").groupBy("query_id", "id", *keep).agg(F.round(F.sum(F.col("asked") * F.col("weight")), 6).alias("score"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """query_id, id, score, rank: the k best chunks of each query."""
    return top(bm25_scores(queries, chunks, tokenizer), ["query_id"], k)


def bm25_by(queries: DataFrame, chunks: DataFrame, group: str, k: int, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """query_id, id, group, score, rank: the k best chunks of each query in each group, so that no group crowds out another."""
    scores = bm25_scores(queries, chunks, tokenizer, (group,))
    return top(scores, ["query_id", group], k)


def top(scores: DataFrame, keys: list[str], k: int, score: str = "score") -> DataFrame:
    """The k best of each key with their rank; ties by id. Spark keeps only k rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Vectors on each side of one comparison.
VECTOR_BLOCK = 4096
#: Queries of a block whose scores are held at once.
VECTOR_STRIP = 256


def dense(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank by cosine, exactly: all queries against all vectors, block by block.

    A block of queries and one of vectors meet in one row, as matrices; each pair gives the k best of its queries. Empty
    vectors and those of length 0 have no score; all vectors have the same number of dimensions.
    """

    def blocks(rows: DataFrame, key: str, vector: str, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-rows.count() // VECTOR_BLOCK))
        rows = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).alias(name), F.struct(F.col(key).alias("id"), F.col(vector).alias("v")).alias("s")).filter(F.size("s.v") > 0)
        return rows.groupBy(name).agg(F.collect_list("s").alias(name + "_rows")), n

    left, n = blocks(queries, "query_id", "query", "qb")
    right, m = blocks(vectors, "id", "vector", "vb")
    pairs = right.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(left, "qb")
    # about a pair of blocks a task: an Arrow batch holds few of them, however many there are
    pairs = pairs.repartition(n * m, "qb", "vb").select("qb_rows", "vb_rows")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"

    def matrix(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        m = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        size = np.sqrt((m * m).sum(1))
        return rows.field("id"), np.divide(m, size[:, None], out=np.full_like(m, np.nan), where=size[:, None] > 0)

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (q_ids, q), (v_ids, v) = (matrix(batch.column(c).slice(r, 1).flatten()) for c in (0, 1))
                order = np.array(v_ids.to_pylist())
                for at in range(0, len(q), VECTOR_STRIP):
                    score = np.round(q[at : at + VECTOR_STRIP] @ v.T, 6) + 0.0
                    best = np.stack([np.lexsort((order, -row))[:k] for row in score])
                    value = np.take_along_axis(score, best, 1).ravel()
                    which = np.repeat(np.arange(at, at + len(score)), best.shape[1])[~np.isnan(value)]
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(which)), v_ids.take(pa.array(best.ravel()[~np.isnan(value)])), pa.array(value[~np.isnan(value)])], ["query_id", "id", "score"])

    return top(pairs.mapInArrow(compare, schema), ["query_id"], k)


def fused(rankings: list[DataFrame], constant: int = RRF) -> DataFrame:
    """query_id, id, score, first_list: the sum of 1 / (constant + rank); ties by the first list and its rank."""
    rows = None
    for n, r in enumerate(rankings):
        one = r.select("query_id", "id", "rank", F.lit(n).alias("list"))
        rows = one if rows is None else rows.union(one)
    out = rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen", "id")
    return out.select("query_id", "id", "score", F.row_number().over(w).alias("rank"))


def interleaved(rankings: list[DataFrame], k: int) -> DataFrame:
    """Turn by turn one from each list; an id counts once, where it comes first."""
    rows = None
    for n, r in enumerate(rankings):
        one = r.select("query_id", "id", F.struct("rank", F.lit(n).alias("list")).alias("turn"))
        rows = one if rows is None else rows.union(one)
    out = rows.groupBy("query_id", "id").agg(F.min("turn").alias("turn"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))).filter(F.col("rank") <= k).select("query_id", "id", "rank")


def reranked(ranked: DataFrame, score: Column, k: int) -> DataFrame:
    """By another score, ties in the order before."""
    w = Window.partitionBy("query_id").orderBy(F.col("new_score").desc(), "old_rank")
    return ranked.withColumnRenamed("rank", "old_rank").withColumn("new_score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def diversified(ranked: DataFrame, document: str) -> DataFrame:
    """The best chunk of each document, with the number of its others."""
    w = Window.partitionBy("query_id", document)
    out = ranked.withColumns({"_n": F.row_number().over(w.orderBy("rank")), "same_doc_hits": F.count("*").over(w) - 1})
    return out.filter("_n = 1").drop("_n")


def capped(ranked: DataFrame, document: str, most: int) -> DataFrame:
    """At most so many chunks of a document, in their order."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", document).orderBy("rank"))).filter(F.col("_n") <= most).drop("_n")


def round_robin(ranked: DataFrame, group: str, per_group: int, k: int) -> DataFrame:
    """The first of every group, then the second of every group, groups by their best score."""
    g = Window.partitionBy("query_id", group)
    out = ranked.withColumns({"_n": F.row_number().over(g.orderBy("rank")), "_best": F.max("score").over(g)}).filter(F.col("_n") <= per_group)
    w = Window.partitionBy("query_id").orderBy("_n", F.col("_best").desc(), group)
    return out.withColumn("merged", F.row_number().over(w)).filter(F.col("merged") <= k).drop("_n", "_best")


def near_pairs(hits: DataFrame, least_jaccard: float = 0.8, least_containment: float = 0.9) -> DataFrame:
    """query_id, a, b, jaccard, containment: the near pairs of each query's few hits (query_id, id, text), by 5-character shingles.

    The hits are stored, so that their ranking is made once. The shingles of each text are made once, as 64-bit hashes,
    and then meet by query.
    """
    hits = stored(hits.select("query_id", "id", "text"), "hits")
    one = hits.select("id", "text").dropDuplicates(["id"])
    sets = stored(one.select("id", F.transform(char_shingles(F.regexp_replace("text", r"\s", "")), lambda s: F.xxhash64(s)).alias("s")), "shingles")
    side = lambda end: hits.select("query_id", F.col("id").alias(end))
    pairs = side("a").join(side("b"), "query_id").filter("a < b")
    met = pairs.select("a", "b").distinct().join(sets.withColumnsRenamed({"id": "a", "s": "sx"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sy"}), "b")
    scored = met.select("a", "b", F.round(jaccard(F.col("sx"), F.col("sy")), 6).alias("jaccard"), F.round(containment(F.col("sx"), F.col("sy")), 6).alias("containment"))
    return pairs.join(scored.filter((F.col("jaccard") >= least_jaccard) | (F.col("containment") >= least_containment)), ["a", "b"]).select("query_id", "a", "b", "jaccard", "containment")


def folded(hits: DataFrame, least_jaccard: float = 0.8, least_containment: float = 0.9) -> DataFrame:
    """query_id, id, rank, older: per query, a hit near an earlier one of its series takes that slot if newer, else is listed with it.

    The order decides, so a query's few hits (id, rank, series, version, text) are treated together.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = []
        for row in pdf.sort_values("rank").itertuples():
            text = "".join(unicodedata.normalize("NFKC", row.text or "").split())
            mine = {text[i : i + 5] for i in range(max(1, len(text) - 4))}
            for slot in slots:
                shared = len(mine & slot["set"])
                near = shared >= least_jaccard * len(mine | slot["set"]) or shared >= least_containment * min(len(mine), len(slot["set"]))
                if slot["series"] == row.series and near:
                    old, new = (slot["id"], row.id) if row.version > slot["version"] else (row.id, slot["id"])
                    if new == row.id:
                        slot.update(id=row.id, version=row.version, set=mine)
                    slot["older"].append(int(old))
                    break
            else:
                slots.append({"id": row.id, "rank": row.rank, "series": row.series, "version": row.version, "set": mine, "older": []})
        return pd.DataFrame([(pdf.query_id.iloc[0], s["id"], s["rank"], s["older"]) for s in slots], columns=["query_id", "id", "rank", "older"])

    return hits.groupBy("query_id").applyInPandas(fold, "query_id long, id long, rank int, older array<long>")


def group_evidence(ranked: DataFrame, group: str, date: str, floor: float) -> DataFrame:
    """query_id, group, hits, top_score, best_id, earliest, earliest_id: what each group's hits at or above the floor say."""
    some = ranked.filter(F.col("score") >= floor)
    first = F.min(F.when(F.col(date).isNotNull(), F.struct(date, "rank", "id"))).alias("e")
    out = some.groupBy("query_id", group).agg(F.count("*").alias("hits"), F.max("score").alias("top_score"), F.min_by("id", "rank").alias("best_id"), first)
    return out.select("query_id", group, "hits", "top_score", "best_id", F.col(f"e.{date}").alias("earliest"), F.coalesce("e.id", "best_id").alias("earliest_id"))


def decided(queries: DataFrame, evidence: DataFrame, group: str, only: list[str], first: list[str]) -> DataFrame:
    """query_id, covering, decision, answer: one group alone covers the question, or the answer is left open.

    A question for the first or greatest is always left open: texts don't tell who was first, however few say so.
    """
    found = evidence.groupBy("query_id").agg(F.count("*").alias("covering"), F.max_by(group, "top_score").alias("best"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w))
    n = F.coalesce("covering", F.lit(0))
    alone = (n == 1) & (has(only) | ~has(first))
    out = queries.select("query_id", "text").join(found, "query_id", "left")
    return out.select("query_id", n.alias("covering"), F.when(alone, "resolve").otherwise("abstain").alias("decision"), F.when(alone, F.col("best")).alias("answer"))


def hit_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: questions, hit@k and MRR of ranked (query_id, id, rank) against gold (query_id, id)."""
    best = gold.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    return best.agg(F.count("*").alias("questions"), *(F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in ks), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def containing(items: DataFrame, texts: DataFrame, width: int = 3) -> DataFrame:
    """(query_id, id): the texts that hold an item's text, both in lower case.

    An item's words but the first and last stand whole in a text that holds it: the first width of them are looked up
    among the texts' runs of words, and only texts with a hit are searched. Items of too few words are compared with all.
    """
    lower = items.select("query_id", F.lower("text").alias("passage")).withColumn("ws", tokens(F.col("passage")))
    inner = F.slice("ws", 2, width)
    long, short = lower.filter(F.size("ws") >= width + 2), lower.filter((F.size("ws") < width + 2) & (F.length("passage") > 0))
    seeds = long.select("query_id", "passage", F.array_join(inner, " ").alias("seed"))
    ws = texts.select("id", F.array(tokens(F.lower("text"))).alias("ws"))
    # as a lambda's argument the words are made once; outer, so that the runs are not made again to see whether there are any
    run = lambda ws: F.transform(ws, lambda w, i: F.concat_ws(" ", w, *(F.get(ws, i + k) for k in range(1, width))))
    runs = ws.select("id", F.explode_outer(F.transform("ws", run)[0]).alias("seed"))
    hit = stored(runs.join(small(seeds), "seed").select("id", "query_id", "passage").distinct(), "hits")
    found = texts.join(small(hit), "id").filter(F.contains(F.lower("text"), F.col("passage"))).select("query_id", "id")
    few = short.select("query_id", "passage")
    if not few.isEmpty():
        found = found.union(texts.join(small(few), F.contains(F.lower("text"), F.col("passage"))).select("query_id", "id"))
    return found


def strategy(question: Column, names: dict[str, list[str]], counting: list[str], covering: list[str]) -> Column:
    """How to search: targeted at the one group named, aggregation, coverage of groups, or plainly.

    A covering word takes away all names. One named group comes first, even with a counting word; then a counting word;
    then a covering word or several groups.
    """
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(question, w))
    n = F.when(has(covering), 0).otherwise(F.size(mentioned(question, names)))
    return F.when(n == 1, "targeted").when(has(counting), "aggregation").when(has(covering) | (n >= 2), "coverage").otherwise("baseline")
