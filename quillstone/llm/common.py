"""Shared pieces of the corpus operators: shared storage, joins on skewed keys, components, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys with more than 1/HOT_SHARE of all rows are hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as keep it apart from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def by_position(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What run makes of docs, with the columns of docs and nothing else.

    run sees doc_id and text, however their names are spelt, and the other columns under names of their own: so no name
    of docs, with dots, in other case or equal to one that run makes, is lost or mistaken.
    """
    plain = [f"column {i}" for i in range(len(docs.columns))]
    for name in ("doc_id", "text"):
        plain[[c.lower() for c in docs.columns].index(name)] = name
    return run(docs.toDF(*plain)).select(*(F.col(f"`{c}`") for c in plain)).toDF(*docs.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/quillstone/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have been stopped before: nothing is left to delete with
            pass

    atexit.register(gone)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote for df, once nothing reads it any more."""
    drop_path(df.sparkSession, df._quillstone_path)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n: decides which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text for each task of an exchange of whole texts, at least.
TASK_BYTES = 64 << 20


def size_of(docs: DataFrame) -> tuple[int, int]:
    """(rows, number of tasks for an exchange of all texts): a pass that reads the texts without moving them."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return n, max(partitions(docs.sparkSession), -(-(size or 0) // TASK_BYTES))


def hot_lookup(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left join of left to right, which has one row a (string) key and, in column size, the number of left's rows with it.

    Keys with over total / HOT_SHARE rows (fewer than HOT_SHARE of them, by counting) are looked up in a broadcast
    table; the others meet in a shuffled join, in which no key has more than that share of the rows.
    """
    names = [c for c in right.columns if c != key]
    k, r, l, hot_, rest_ = unused(left, "k", "r", "l", "hot", "rest")
    hot = right.filter(F.col(size) * HOT_SHARE > total).select(F.col(key).alias(k), F.struct(*names).alias(hot_))
    rest = right.filter(F.col(size) * HOT_SHARE <= total).select(F.col(key).alias(r), F.struct(*names).alias(rest_))
    out = left.join(F.broadcast(hot), left[key] == F.col(k), "left")
    # hot rows have been found, and null keys find nothing: keys that match nothing spread them in the second join
    own = F.concat(F.lit("\0"), F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)).cast("string"))
    out = out.withColumn(l, F.when(F.col(k).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    out = out.join(rest, F.col(l) == F.col(r), "left")
    found = F.coalesce(F.col(hot_), F.col(rest_))
    return out.select(*(F.col(f"`{c}`") for c in left.columns), *(found[n].alias(n) for n in names))


#: Links that a task is given to join up before the rounds; it holds at most as many nodes at once.
FOREST_LINKS = 500_000


def local_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same nodes as edges, a stored table, do: each task replaces those it reads by stars."""
    tasks = -(-edges.count() // FOREST_LINKS)

    def run(batches):
        above = {}

        def top(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        def stars():
            ids = [x for x in above if top(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([top(x) for x in ids], pa.int64()), pa.array(ids, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
            if len(above) > FOREST_LINKS:
                yield stars()
                above.clear()
        if above:
            yield stars()

    return edges.coalesce(max(1, tasks)).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(id, component): for each node of edges (a, b), the smallest node that it reaches.

    Each task first joins up the links that it reads; then the large-star and small-star steps alternate on DataFrames,
    and every round is stored in the shared folder. The joins are plain equi-joins, whose skewed partitions adaptive
    execution splits.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))

    def joined(e: DataFrame) -> DataFrame:
        return e.join(least(e), F.col("u") == F.col("k"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = local_forest(edges.filter("a <> b").select("a", "b"))
    now = stored(now.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), tag)
    mark = state(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = joined(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        pairs = joined(large)
        small = pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, tag)
        last, mark = mark, state(new)
        forget(now)
        now = new
        if mark == last:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
