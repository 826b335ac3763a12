"""Quality scores learned from preference pairs: Bradley-Terry on feature differences, cut where the labels part.

All labelled rows that are not held out teach: blocks of them are fitted by one task each, their weights averaged, and the
cut is found from counts of all strengths.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, remainder, stored
from .words import spaced_words

#: Labelled rows that are fitted together, about; more make more blocks, and every row is in one.
FIT_ROWS = 20_000
#: Ranges of equal width in which strengths are counted to find the cut.
BINS = 1 << 16
#: Preference pairs for each row of the rarer label.
PAIRS = 40


def features(text: bytes) -> list[float]:
    """Shares and logarithms that don't grow with the text beyond its length's logarithm."""
    words = spaced_words(text)
    n, size = max(len(words), 1), max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, high = counts[48:58].sum(), counts[128:].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    plain = counts[44] + counts[46]  # commas and full stops
    seen = Counter(words)
    top = max(seen.values(), default=0)
    bare = sum(map(len, (w for w in words if not w[-1:].isalpha() and w[-1:] not in (b".", b",") and w[-1] < 128)))
    alone = sum(c for w, c in seen.items() if len(w) == 1 and not w.isalnum() and w[0] < 128)
    lines = text.split(b"\n")
    x = [
        math.log(n + 1), math.log(size / n), upper / size, lower / size, digits / size, high / size, math.sqrt((marks - plain) / size), plain / size,
        len(seen) / n, math.log(len(seen) + 1) / math.log(n + 1.5), top / n, math.sqrt(sum(map(eq, words, words[1:])) / n), math.sqrt(bare / size), math.sqrt(alone / n),
        len(set(lines)) / len(lines), math.log(size / len(lines)), float(len(words) < 5), math.sqrt(upper / max(upper + lower, 1)),
    ]
    return [float(v) for v in x]


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1.0, seed: int = 11, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights): a document's strength is weights . (x - mean) / scale; mean and scale are x's own unless given.

    Each pair prefers a row of label 1 to one of label 0; P(preferred) is the logistic function of the strengths'
    difference, so the fit is a logistic regression on feature differences, without a constant, by Newton's method.
    """
    mean, scale = x.mean(0) if mean is None else mean, x.std(0) if scale is None else scale
    scale = np.where(scale < 1e-9, 1, scale)
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return mean, scale, w
    rng = np.random.default_rng(seed)
    n = pairs * min(len(good), len(bad))
    few, many = (good, bad) if len(good) < len(bad) else (bad, good)
    a, b = np.tile(few, pairs), many[rng.integers(0, len(many), n)]
    d = z[a] - z[b] if few is good else z[b] - z[a]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(len(w)), d.T @ (1 - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def cut(low: float, width: float, bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The level of the strengths that parts the labels best, each label with equal weight; from counts of bins of them.

    A level lies midway between two bins with rows; the lowest strength, to which every row comes up, is one too.
    """
    levels = np.append(low, low + width * (bins[1:] + bins[:-1] + 1) / 2)
    below = lambda counts: np.append(0, np.cumsum(counts)[:-1]) / max(counts.sum(), 1)
    right = 1 - below(good) + below(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(levels[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """A model (mean, scale, weights, cut) from all labelled rows whose crc32 remainder by 3 is not 1, or None without any.

    A doc_id whose labels disagree, or that is null, teaches nothing. Of documents that share a doc_id each is a row.
    Features are made once; blocks of about `rows` of them give weights for the same mean and scale, of which the mean
    by preference pairs is the model's: up to `rows` labelled rows, the fit is one regression.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.filter(remainder(F.col("_id"), 3) != 1).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_y").alias("_least")).filter("_y = _least").drop("_least")

    def described(batches):
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).filter(remainder(F.col("id"), 3) != 1)
    # features meet the labels, not texts: what is shuffled is small
    each = texts.mapInArrow(described, "id long, x array<double>")
    each = stored(each.join(known, each["id"] == known["_id"]).select("id", F.col("_y").alias("y"), "x"), "features")
    size = len(features(b""))
    n, *moments = each.agg(F.count("*"), *(f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(size))).first()
    if not n:
        forget(each)
        return None
    mean, scale = np.array(moments[:size]), np.array(moments[size:])
    scale[scale < 1e-9] = 1

    def block(table: pa.Table) -> pa.Table:
        held = sorted(zip(table.column("y").to_pylist(), table.column("x").to_pylist()))
        x, y = np.array([r[1] for r in held]), np.array([r[0] for r in held])
        w = bradley_terry(x, y, mean=mean, scale=scale)[2]
        return pa.table({"block": table.column("block")[:1], "n": pa.array([float(min(y.sum(), len(y) - y.sum()))]), "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    dealt = each.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(-(-n // rows))))
    parts = dealt.groupBy("block").applyInArrow(block, "block long, n double, w array<double>").collect()  # a row of weights for each block
    parts.sort()
    w = np.sum([np.array(p[2]) * p[1] for p in parts], 0) / max(sum(p[1] for p in parts), 1)

    def strengths(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array((x - mean) / scale @ w)], ["y", "s"])

    strength = each.select("y", "x").mapInArrow(strengths, "y long, s double")
    low, high = strength.agg(F.min("s"), F.max("s")).first()
    width = (high - low) / BINS or 1.0
    counts = strength.groupBy(F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.sum("y"), F.count("*") - F.sum("y")).collect()  # BINS rows at most
    forget(each)
    return mean, scale, w, cut(low, width, *np.array(sorted(counts), np.int64).T)


def scored(docs: DataFrame, model) -> DataFrame:
    """docs with score (0 to 1; 0.5 at the cut) and predicted, from whole texts alone; without a model 0.5 and 1.

    A null text counts as empty and is scored like one. Columns of docs with these names, in any case, are replaced;
    other columns may have any names.
    """
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    if model is None:
        return docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1))
    place = [c.lower() for c in names].index("text")
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # columns go by position, as their names may be anything
    mean, scale, w, level = model

    def run(batches):
        for batch in batches:
            x = np.array([features((t.as_py() or "").encode()) for t in batch.column(place)]).reshape(-1, len(w))
            score = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w - level, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype("i4"))], [*batch.schema.names, "score", "predicted"])

    out = docs.mapInArrow(run, docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1)).schema)
    return out.toDF(*names, "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs with held_out, score and predicted; learned from labels of rows that are not held out.

    Null and empty texts are scored alike; a row without doc_id is not held out, and repeated rows have equal results.
    """
    out = scored(docs, fit(docs.select("doc_id", "text"), labels, rows))
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
