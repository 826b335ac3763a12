"""Merkle manifest: positions dealt by ranges, nodes climbed block by block, and authentication paths by tree traversal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions, stored, unused

#: Fixed value: so many nodes of a run become one node.
FAN_OUT = 16
#: Levels of a block: a task holds the FAN_OUT ** LEVELS digests of one block.
LEVELS = 3
BLOCK = FAN_OUT**LEVELS
#: Rows of nodes for each task of an exchange, at least (about 150 bytes each).
TASK_ROWS = 400_000
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def joined_hash(digests) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Treehash:
    """Nodes of one height from leaves given one by one: each level below holds the run in work, fewer than FAN_OUT."""

    def __init__(self, height: int):
        self.runs, self.nodes = [[] for _ in range(height)], []

    def _put(self, level: int, digest: str) -> None:
        if level == len(self.runs):
            self.nodes.append(digest)
            return
        self.runs[level].append(digest)
        if len(self.runs[level]) == FAN_OUT:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self._put(level + 1, joined_hash(run))

    def add(self, digest: str) -> None:
        self._put(0, digest)

    def finish(self) -> list[str]:
        """The nodes, when no leaf follows: runs in work, even of one, become nodes."""
        for level in range(len(self.runs)):
            if self.runs[level]:
                self._close(level)
        return self.nodes


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn its siblings on each level as (those left of it, those right of it).

    Each level keeps the nodes of its present run, and a treehash that takes in one leaf of the next run for each leaf
    that is passed: the next run is ready when the present one ends. So a level holds two runs and one run for each level
    below, FAN_OUT times the levels' square in all.
    """
    n = len(leaves)
    spans = [FAN_OUT ** (h + 1) for h in range(levels)]
    now, ahead, sides = [], [Treehash(h) for h in range(levels)], [("", "")] * levels
    for h, span in enumerate(spans):
        first = Treehash(h)
        for digest in leaves[:span]:
            first.add(digest)
        now.append(first.finish())
    for i in range(n):
        for h in range(levels):
            step = FAN_OUT**h
            if i % step == 0:
                at = i // step % FAN_OUT
                sides[h] = ("".join(now[h][:at]), "".join(now[h][at + 1 :]))
        yield list(sides)
        for h, span in enumerate(spans):
            if i + span < n:
                ahead[h].add(leaves[i + span])
            if (i + 1) % span == 0:
                now[h], ahead[h] = ahead[h].finish(), Treehash(h)


def levels_of(n: int) -> int:
    """Levels that a block of a tree with n nodes has: until one node is left, LEVELS at most."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def leaf_text(*columns: Column) -> Column:
    """The columns one after another, each - if null, else its UTF-8 byte count, a colon and its value."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat(*each)


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: SHA-256 in lower-case hex of leaf_text."""
    return F.sha2(leaf_text(*columns).cast("binary"), 256)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s.left, s.right)), "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has with a proof's siblings."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s.left, digest, s.right).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, order: list[str], tag: str) -> DataFrame:
    """rows, stored, with pos, their place in the order among the rows of their tree, and n, how many those are.

    Rows are dealt by ranges of (tree, order), so that a tree with very many rows spans tasks; what the tasks before one
    hold of its tree is added to the place in the task. Each row also has its own number in the order, so that equal rows
    don't gather in one task.
    """
    spark, (own_, at_, task_) = rows.sparkSession, unused(rows, "own", "at", "task")
    rows = stored(rows.withColumn(own_, F.monotonically_increasing_id()), f"{tag}-rows")
    tasks = max(partitions(spark), -(-rows.count() // TASK_ROWS))
    keys = [tree, *order, own_]
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn(at_, F.monotonically_increasing_id()).withColumn(task_, F.spark_partition_id()), f"{tag}-dealt")
    forget(rows)
    runs = dealt.groupBy(tree, task_).agg(F.min(at_).alias("first"), F.count("*").alias("k"))
    # a tree has at most one run in each task, so these windows hold no more rows than there are tasks
    w = Window.partitionBy(tree)
    before = F.sum("k").over(w.orderBy(task_).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col(tree).alias("of_tree"), F.col(task_).alias("of_task"), F.coalesce(before, F.lit(0)).alias("before"), "first", F.sum("k").over(w).alias("n"))
    # rows of a run meet its numbers in a join on the run, which has a task's rows at most
    out = dealt.join(runs, (F.col(tree) == F.col("of_tree")) & (F.col(task_) == F.col("of_task")))
    return stored(out.select(*(F.col(f"`{c}`") for c in dealt.columns if c not in (own_, at_, task_)), (F.col(at_) - F.col("first") + F.col("before")).alias("pos"), "n"), f"{tag}-numbered")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows of (tree, block, pos, ...), each block whole and in order within a task, however many rows its tree has."""
    tasks = max(partitions(rows.sparkSession), -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _runs(batches):
    """Lists of rows that have the same (tree, block)."""
    have = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if have and have[0][:2] != row[:2]:
                yield have
                have = []
            have.append(row)
    if have:
        yield have


def _climb(batches):
    """One node a block: (tree, pos, digest, n of its level)."""
    rows = []
    for run in _runs(batches):
        tree, block, _, _, n = run[0]
        hashing = Treehash(levels_of(n))
        for row in run:
            hashing.add(row[3])
        rows.append((tree, block, hashing.finish()[0], -(-n // BLOCK)))
        if len(rows) == 5000:
            yield _nodes(rows)
            rows = []
    if rows:
        yield _nodes(rows)


def _nodes(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["tree", "pos", "digest", "n"])


def climbed(leaves: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored rounds (tree, pos, digest, n) from the leaves up, and (tree, digest, round) of each tree's root."""
    rounds = [leaves.select("tree", "pos", "digest", "n")]
    roots = []
    while True:
        own = _blocks(rounds[-1].select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "digest", "n"))
        nodes = stored(own.mapInArrow(_climb, "tree string, pos long, digest string, n long"), f"{tag}-nodes")
        roots.append(nodes.filter("n = 1").select("tree", "digest", F.lit(len(rounds)).alias("round")))
        more = nodes.filter("n > 1")
        if more.isEmpty():
            break
        rounds.append(more)
    out = roots[0]
    for r in roots[1:]:
        out = out.union(r)
    return rounds, out


def _traverse(batches):
    """Paths of a block's nodes: the first row has the path that they share from the block's root on, and the tree's root."""
    out = []
    for run in _runs(batches):
        shared, nodes = run[0], run[1:]
        above = [(s["left"], s["right"]) for s in shared[5]]
        sides = traverse([r[3] for r in nodes], levels_of(nodes[0][4]))
        for (tree, _, pos, digest, _, _, id_, carried), own in zip(nodes, sides):
            out.append((tree, pos, digest, id_, carried, shared[3], [{"left": a, "right": b} for a, b in own + above]))
            if len(out) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PLACE.types)], _PLACE.names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PLACE.types)], _PLACE.names)


_PLACE = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("id", pa.int64()), ("carried", pa.list_(pa.string())), ("subroot", pa.string()), ("path", _PATH)])
_PLACE_DDL = f"tree string, pos long, digest string, id long, carried array<string>, subroot string, path {PATH}"


def paths(leaves: DataFrame, rounds: list[DataFrame], tops: DataFrame, tag: str) -> DataFrame:
    """(tree, pos, digest, id, carried, subroot, path) of every leaf; tops: (tree, subroot, path from there on, round).

    From the top round down each block gets the path of its root as its first row, before its nodes, in one exchange.
    """
    above = None
    for r in range(len(rounds) - 1, -1, -1):
        due = tops.filter(F.col("round") == r + 1).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
        if above is not None:
            due = due.union(above.select("tree", F.col("pos").alias("block"), "subroot", "path"))
        nodes = rounds[r].withColumn("id", F.lit(None).cast("long")).withColumn("carried", F.lit(None).cast("array<string>")) if r else leaves
        rows = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "digest", "n", F.lit(None).cast(PATH).alias("path"), "id", "carried")
        shared = due.selectExpr("tree", "block", "-1L", "subroot", "null", "path", "null", "null")
        above = _blocks(rows.union(shared)).mapInArrow(_traverse, _PLACE_DDL)
        if r:
            above = stored(above, f"{tag}-paths")
    return above


def manifest(docs: DataFrame, columns: list[str], tree: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """The order column (integers), the strings named in carry, leaf, subroot, root and proof for each row of docs.

    A row's leaf is leaf_of(columns). The leaves of a tree ascend by the order column (null first, ties by leaf); every
    FAN_OUT consecutive nodes become one until one is left, and the trees' roots, by the tree column (null first, bytewise),
    become the root alike. proof has each level's siblings from the leaf to the root: folded(leaf, proof) is the root.

    Rows that stand twice are leaves of their own. Nulls are values of their own anywhere; columns that aren't named play
    no part, whatever their names. An empty table gives an empty result, as it has no root. Only digests and the carried
    strings are moved, never texts; a task holds one block of BLOCK digests and its shared path.
    """
    spark, carry = docs.sparkSession, carry or {}
    col = lambda c: F.col(f"`{c}`")
    key = F.coalesce(F.concat(F.lit("="), col(tree).cast("string")), F.lit("-"))
    rows = docs.select(key.alias("tree"), col(order).cast("long").alias("id"), leaf_of(*map(col, columns)).alias("digest"), F.array(*carry.values()).cast("array<string>").alias("carried"))
    leaves = numbered(rows, "tree", ["id", "digest"], "leaves")
    rounds, roots = climbed(leaves, "trees")
    roots = stored(roots, "subroots")
    tops = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), "digest", F.col("round").alias("at")), "tree", ["part"], "tops")
    upper, whole = climbed(tops, "root")
    found = whole.select("digest", "round").first()
    root = found and found.digest
    end = spark.createDataFrame([("", root, [], found.round)] if found else [], f"tree string, subroot string, path {PATH}, round int")
    named = tops.select("tree", "pos", "digest", "n", F.lit(None).cast("long").alias("id"), F.array("part", F.col("at").cast("string")).alias("carried"))
    parts = stored(paths(named, upper, end, "root"), "parts")
    due = parts.select(F.col("carried")[0].alias("tree"), F.col("digest").alias("subroot"), "path", F.col("carried")[1].cast("int").alias("round"))
    out = paths(leaves, rounds, due, "trees")
    return out.select(F.col("id").alias(order), *(F.col("carried")[i].alias(c) for i, c in enumerate(carry)), F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.col("path").alias("proof"))
