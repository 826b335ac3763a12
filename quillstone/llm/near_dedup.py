"""Near-duplicate detection by an LSH forest over MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, hot_lookup, stored, unused
from .words import Hashes, mixed, odd_numbers, spaced_words

SHINGLE = 5
#: Links need at least this Jaccard similarity, in hundredths.
PERCENT = 75
HASHES = 128
#: Sorted orders, hashes by which each is ordered, and hashes that neighbours must share at least.
TREES, DEPTH, SHARED = 24, 8, 3
#: Neighbours on either side that a document is compared with in each order.
WINDOW = 3
#: Shingles on each side of one comparison of a region deeper than the window, and documents likewise.
BLOCK_SHINGLES, BLOCK = 2_000_000, 8192
#: Of 128 four-bit hashes so many must agree for a pair to be a candidate; at similarity 0.75 fewer are 4.5 standard deviations away.
AGREE = 76
#: Rounds in which each group tries its best candidate only; then all candidates between groups are confirmed.
BEST_ROUNDS = 1
#: Shingles of texts that a task keeps for further pairs or regions of the same documents.
SETS_HELD = 4_000_000
#: Up to so many ids (with digests, under 100 bytes each) are broadcast to pick texts; beyond, the texts are shuffled.
BROADCAST_IDS = 300_000
FACTORS = odd_numbers(HASHES, 3)
_PLACES = odd_numbers(SHINGLE, 5)


def shingle_set(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, from those of its words; fewer words make one shingle, none none."""
    if not len(hashes):
        return hashes
    size = min(width, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out + hashes[k : k + n] * _PLACES[k]
    return np.unique(mixed(mixed(out)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value under each of HASHES functions, as 32 bits."""
    out = np.empty(HASHES, np.uint64)
    step = max(1, 200_000 // len(shingles))
    for k in range(0, HASHES, step):
        out[k : k + step] = (FACTORS[k : k + step, None] * shingles[None, :]).min(1)
    return (out >> np.uint64(32)).astype(np.uint32)


def words_key(words: list[bytes]) -> str | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest() if words else None


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, words, n_shingles, signature): 64 bits of the text, a digest of the words; one row of it a task is signed."""

    def run(batches):
        hashes, seen = Hashes(), set()
        for batch in batches:
            keys, sizes, signs = [], [], []
            for text in batch.column(2):
                words = spaced_words(text.as_py() or b"")
                key = words_key(words)
                keys.append(key)
                shingles = shingle_set(hashes.of(words))
                sizes.append(len(shingles))
                if key is None or key in seen:
                    signs.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                signs.append(signature(shingles).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "mark", "words", "n_shingles", "signature"])

    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(run, "doc_id long, mark long, words string, n_shingles long, signature binary")


_ROW = pa.schema([("tree", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("id", pa.int64()), ("sketch", pa.binary()), ("grp", pa.int64())])


def orders(classes: DataFrame) -> DataFrame:
    """A row for each class and order: the order's hashes, 16 bits each, in two integers, and a sketch of the signature."""

    def run(batches):
        places = (np.arange(TREES)[:, None] * (HASHES // TREES) + np.arange(DEPTH)[None, :] * 1) % HASHES
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ids = np.array(batch.column(0)[at : at + 2000].to_pylist(), np.int64)
                signs = np.frombuffer(b"".join(batch.column(1)[at : at + 2000].to_pylist()), "<u4").reshape(len(ids), HASHES)
                half = (signs[:, places] & 0xFFFF).astype(np.uint64)  # class, tree, depth
                high, low = np.zeros((2, len(ids), TREES), np.uint64)
                for k in range(4):
                    high |= half[:, :, k] << np.uint64(48 - 16 * k)
                    low |= half[:, :, 4 + k] << np.uint64(48 - 16 * k)
                nibbles = (signs >> 16 & 15).astype(np.uint8)
                sketch = pa.array([s.tobytes() for s in nibbles[:, ::2] << 4 | nibbles[:, 1::2]], pa.binary())
                where = pa.array(np.repeat(np.arange(len(ids)), TREES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(ids))), pa.array(high.ravel().view(np.int64)), pa.array(low.ravel().view(np.int64)), pa.array(np.repeat(ids, TREES)), sketch.take(where), batch.column(2)[at : at + 2000].take(where)], schema=_ROW
                )

    grp = F.col("grp") if "grp" in classes.columns else F.col("id")
    return classes.select("id", "signature", grp.alias("grp")).mapInArrow(run, "tree int, high long, low long, id long, sketch binary, grp long")


_PAIR = "a long, b long, agree int, tree int, high long, low long, id long, sketch binary, grp long"


def neighbours(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Candidate pairs (a, b, agree) of sorted rows, and the rows at both ends of each partition (a null), to be joined up."""

    def pairs_of(tree, high, low, ids, sketch, grp, new_from):
        """Pairs within the window, of different groups, whose later row is at new_from or after it."""
        region = high.view(np.uint64) >> np.uint64(16 * (4 - SHARED))
        out = [(np.zeros(0, np.int64),) * 3]
        alive = np.arange(new_from, len(ids))
        for step in range(1, window + 1):
            j = alive[alive >= step]
            i = j - step
            same = (tree[i] == tree[j]) & (region[i] == region[j])
            alive, i, j = j[same], i[same], j[same]
            if not len(alive):  # no region reaches further
                break
            other = grp[i] != grp[j]
            i, j = i[other], j[other]
            x = sketch[i] ^ sketch[j]
            agree = ((x & 0xF0) == 0).sum(1) + ((x & 0x0F) == 0).sum(1)
            near = agree >= AGREE
            out.append((np.minimum(ids[i], ids[j])[near], np.maximum(ids[i], ids[j])[near], agree[near]))
        a, b, agree = (np.concatenate(c) for c in zip(*out))
        return a, b, agree

    def unpack(batch):
        return [
            np.array(batch.column(0)), np.array(batch.column(1)), np.array(batch.column(2)), np.array(batch.column(3)),
            np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, HASHES // 2),
            np.array(batch.column(5)),
        ]

    def regions(columns):
        return np.stack([columns[0].astype(np.uint64), columns[1].view(np.uint64) >> np.uint64(16 * (4 - SHARED))])

    def beside(columns, place):
        """The rows in the region at an end of the partition: no others pair with rows past that end."""
        same = (regions(columns) == place).all(0)
        return [c[same] for c in columns]

    def run(batches):
        tail, lead, first = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = unpack(batch)
            lead = regions(now)[:, :1] if lead is None else lead
            ends = [c[: max(0, window - first)] for c in now]  # the partition's first rows
            first += len(ends[0])
            ends = beside(ends, lead)
            both = now if tail is None else [np.concatenate(c) for c in zip(tail, now)]
            a, b, agree = pairs_of(*both, len(both[0]) - len(now[0]))
            tail = [c[-window:] for c in both]
            yield from emit(a, b, agree, ends)
        if tail is not None:
            yield from emit(*(np.zeros(0, np.int64),) * 3, beside(tail, regions(tail)[:, -1:]))

    def emit(a, b, agree, ends):
        n, m = len(a), len(ends[0])
        none = [None] * m
        columns = [pa.array([*a.tolist(), *none], pa.int64()), pa.array([*b.tolist(), *none], pa.int64()), pa.array([*agree.tolist(), *none], pa.int32())]
        columns += [pa.array([None] * n + (c.tolist() if k != 4 else [s.tobytes() for s in c]), t) for k, (c, t) in enumerate(zip(ends, _ROW.types))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PAIR.split(", ")])

    return rows.mapInArrow(run, _PAIR)


def candidates(classes: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct pairs (a, b, agree) of class ids that are near each other in some sorted order.

    Rows are dealt by ranges of (order, hashes, id), so that a region of many documents with equal hashes is spread over
    tasks too. In an order a document is compared with its nearest neighbours by longest common prefix: the depth to
    which they agree follows the density of the region. The ends of the partitions are compared in one small task.
    """
    spark = classes.sparkSession
    key = ["tree", "high", "low", "id"]
    found = stored(neighbours(orders(classes).repartitionByRange(*key).sortWithinPartitions(*key), window), "neighbours")
    ends = found.filter("a IS NULL").select(*(n.name for n in _ROW)).distinct()
    more = neighbours(ends.repartition("tree", F.shiftright("high", 16 * (4 - SHARED))).sortWithinPartitions(*key), window).filter("a IS NOT NULL")
    out = found.filter("a IS NOT NULL").select("a", "b", "agree").union(more.select("a", "b", "agree"))
    return out.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches):
        hashes, sets, held = Hashes(), {}, 0

        def set_of(i, text):
            nonlocal held
            if i not in sets:
                if held > SETS_HELD:
                    sets.clear()
                    held = 0
                sets[i] = shingle_set(hashes.of(spaced_words(text.as_py())))
                held += len(sets[i])
            return sets[i]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                mine, other = set_of(a, x), set_of(b, y)
                low, high = sorted((len(mine), len(other)))
                if 100 * low < percent * high:  # even if one held the other
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(mine) + len(other) - shared) > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def labelled(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """pairs with ca and cb, the groups of their ends; without groups each id is its own."""
    for end in "ab":
        if groups is None:
            pairs = pairs.withColumn(f"c{end}", F.col(end))
        else:
            pairs = pairs.join(groups.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs


def regions_of(classes: DataFrame) -> DataFrame:
    """(id, n_shingles, regions): in each order the hashes that a class's region shares, in one integer."""

    def run(batches):
        places = np.arange(TREES)[:, None] * (HASHES // TREES) + np.arange(SHARED)[None, :]
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(batch.num_rows, HASHES)
            half = (signs[:, places] & 0xFFFF).astype(np.int64)  # class, tree, depth
            region = half[:, :, 0]
            for k in range(1, SHARED):
                region = region << 16 | half[:, :, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(region), pa.list_(pa.int64()))], ["id", "n_shingles", "regions"])

    return classes.select("id", "n_shingles", "signature").mapInArrow(run, "id long, n_shingles long, regions array<long>")


def deep_rows(classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(id, regions, grp, tree, region, left, right, block): where the classes of regions deeper than the window meet.

    Regions of one group are done. The others are cut into blocks by a hash of the id, and each pair of blocks is
    compared in one place, so that no task holds more than two blocks, of bounded size, however many documents a region
    has. The region's largest group has blocks of its own, which aren't compared with each other.
    """
    named = regions_of(classes).withColumn("grp", F.col("id"))
    if groups is not None:
        named = regions_of(classes).join(groups, "id", "left").select("id", "n_shingles", "regions", F.coalesce("component", "id").alias("grp"))
    named = stored(named, "regions")
    each = named.select("id", "n_shingles", "grp", F.posexplode("regions").alias("tree", "region"))
    depth = each.groupBy("tree", "region").agg(F.count("*").alias("n")).filter(F.col("n") > WINDOW + 1).drop("n")
    each = stored(each.join(depth, ["tree", "region"]), "deep")
    sizes = each.groupBy("tree", "region", "grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).groupBy("tree", "region")
    sizes = sizes.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "grp")).alias("top")).filter(F.col("n") > F.col("top.n"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES))
    blocks = sizes.select("tree", "region", F.col("top.grp").alias("top"), parts(F.col("top.n"), F.col("top.s")).alias("mine"), parts(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("others"))
    at = each.join(blocks, ["tree", "region"]).drop("n_shingles")
    own, spread, end = F.col("grp") == F.col("top"), F.xxhash64("id"), F.col("mine") + F.col("others") - 1
    at = at.withColumn("block", F.when(own, F.pmod(spread, "mine")).otherwise(F.col("mine") + F.pmod(spread, "others")))
    # the top group's blocks meet the others' alone
    at = at.withColumn("other", F.explode(F.when(own, F.sequence("mine", end)).otherwise(F.sequence(F.lit(0).cast("long"), end))))
    at = at.select("tree", "region", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id", "grp")
    return at.join(named.select("id", "regions"), "id")


def deep_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links of similar classes that join, with the groups so far, all that are similar within the regions of rows.

    Where two blocks meet, full shingle sets are compared: a document with all others that are not in its group yet,
    and that it didn't meet in an earlier order; the links found join groups at once. So at most one link a group is
    returned, and no pair of one group is compared.
    """
    key = ["tree", "region", "left", "right"]

    def compare(tree, same, x, y):
        """x and y: ids, groups, regions, sets of the blocks' documents, in arrays; same: they are one block."""
        ids, grp, regions, sets = (list(c) if same else [*c, *d] for c, d in zip(x, y))
        n, first = len(ids), 0 if same else len(x[0])  # y begins at first
        grp, regions = np.array(grp), np.array(regions, np.int64).reshape(n, TREES)[:, :tree]
        sizes = np.fromiter(map(len, sets), np.int64, n)
        # shingles that only one document has can't be shared
        values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        holder = np.repeat(np.arange(n), sizes)
        often = times[number] > 1
        number, holder = number[often], holder[often]
        begins = np.searchsorted(holder, np.arange(n + 1))
        mine = np.zeros(len(values), bool)
        for i in range(n if same else first):
            lo = i + 1 if same else first
            near = (grp[lo:] != grp[i]) & (100 * np.minimum(sizes[lo:], sizes[i]) >= PERCENT * np.maximum(sizes[lo:], sizes[i]))
            j = lo + np.flatnonzero(near)
            if tree and len(j):
                j = j[~(regions[j] == regions[i]).any(1)]
            if not len(j):
                continue
            mine[number[begins[i] : begins[i + 1]]] = True
            if 4 * len(j) > n - lo:
                ahead = np.concatenate([[0], np.cumsum(mine[number[begins[lo] :]])])
                shared = ahead[begins[j + 1] - begins[lo]] - ahead[begins[j] - begins[lo]]
            else:
                shared = np.array([np.count_nonzero(mine[number[begins[k] : begins[k + 1]]]) for k in j])
            mine[number[begins[i] : begins[i + 1]]] = False
            for k in j[100 * shared >= PERCENT * (sizes[i] + sizes[j] - shared)].tolist():
                if grp[k] != grp[i]:
                    yield ids[i], ids[k]
                    grp[grp == grp[k]] = grp[i]

    def run(batches):
        hashes, sets, held = Hashes(), {}, 0
        place, parts = None, []

        def flush():
            sides = [[r for r in parts if r[0] == k] for k in place[2:]]
            pairs = list(compare(place[0], place[2] == place[3], *([[r[c] for r in side] for c in (1, 2, 3, 4)] for side in sides)))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for *now, block, i, grp, regions, text in zip(*(c.to_pylist() if k < 8 else c for k, c in enumerate(batch.columns))):
                if parts and now != place:
                    yield flush()
                    parts = []
                place = now
                if i not in sets:
                    if held > SETS_HELD:
                        sets.clear()
                        held = 0
                    sets[i] = shingle_set(hashes.of(spaced_words(text.as_py())))
                    held += len(sets[i])
                parts.append((block, i, grp, regions, sets[i]))
        if parts:
            yield flush()

    rows = rows.join(texts, "id").select(*key, "block", "id", "grp", "regions", "text")
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def settled(rest: DataFrame, texts: DataFrame, groups: DataFrame | None) -> DataFrame | None:
    """Groups after the candidates rest (a, b, agree) between different groups; None if there is no group yet.

    As in Boruvka's algorithm each group at first tries its best candidate only, so that large groups of copies join
    after few comparisons; candidates within one group need no comparison any more. Those that are left between
    different groups are all confirmed, so no candidate is given up.
    """
    for turn in range(BEST_ROUNDS + 1):
        rest = stored(labelled(rest.select("a", "b", "agree"), groups).filter("ca <> cb"), "rest")
        if rest.isEmpty():
            break
        if turn < BEST_ROUNDS:
            edge = F.struct("agree", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
            best = rest.select(F.col("ca").alias("c"), edge.alias("e")).union(rest.select("cb", edge)).groupBy("c").agg(F.max("e").alias("e"))
            some = stored(best.select((-F.col("e.a")).alias("a"), (-F.col("e.b")).alias("b")).distinct(), "tried")
        else:
            some = rest.select("a", "b")
        found = stored(confirmed(some, texts), "links")
        if groups is not None:  # the groups so far, as stars
            found = found.union(groups.select(F.col("component").alias("a"), F.col("id").alias("b")))
        groups = stored(components(found, "groups"), "groups")
        if turn < BEST_ROUNDS:
            rest = rest.join(some, ["a", "b"], "left_anti")
    return groups


def texts_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, text) of the classes in nodes: a text of the class's doc_id that has its words."""
    wanted = classes.join(nodes, "id").select("id", F.col("doc_id").alias("wanted"), "words")
    few = wanted.count() <= BROADCAST_IDS
    some = docs.select(F.col("doc_id").cast("long").alias("wanted"), F.col("text").cast("binary")).join(F.broadcast(wanted) if few else wanted, "wanted").select("id", "words", "text")

    def run(batches):
        for batch in batches:
            fits = [words_key(spaced_words(t.as_py() or b"")) == w for w, t in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fits, pa.bool_())) for c in (batch.column(0), batch.column(2))], ["id", "text"])

    # rows of one doc_id with the same words would come twice
    return some.mapInArrow(run, "id long, text binary").groupBy("id").agg(F.first("text").alias("text"))


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, component) of classes that are linked with others.

    The first search compares neighbours, by longest common prefix, in every order, and joins most of a dense region;
    a region of at most WINDOW + 1 rows is compared whole. Then the regions that are deeper than the window and still
    have several groups are compared whole.
    """
    spark = docs.sparkSession

    def texts(nodes):
        return stored(texts_of(docs, nodes, classes), "texts")

    tried = stored(candidates(classes), "candidates").select("a", "b", F.col("agree").cast("long"))
    some = texts(tried.select(F.col("a").alias("id")).union(tried.select("b")).distinct())
    groups = settled(tried, some, None)
    forget(some)
    rows = stored(deep_rows(classes, groups), "deep-rows")
    if not rows.isEmpty():
        some = texts(rows.select("id").distinct())
        found = stored(deep_links(rows, some), "deep-links")
        forget(some)
        if not found.isEmpty():
            if groups is not None:  # the groups so far, as stars
                found = found.union(groups.select(F.col("component").alias("a"), F.col("id").alias("b")))
            groups = stored(components(found, "groups"), "groups")
    forget(rows)
    return groups if groups is not None else spark.createDataFrame([], "id long, component long")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, mark (64 bits of the text), n_shingles, component_id, kept for each row of docs: see near_duplicates."""
    all_rows = stored(signed(docs), "signed")
    total = all_rows.count()
    some = all_rows.filter("words IS NOT NULL AND doc_id IS NOT NULL")
    ids = some.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("size"))
    signs = some.filter("signature IS NOT NULL").select("words", "signature").groupBy("words").agg(F.first("signature").alias("signature"))
    # a number of its own for each class, as texts with other words may have the same doc_id
    classes = stored(stored(ids.join(signs, "words"), "sets").withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = links(classes, docs)
    both = classes.join(groups, "id", "left").select("words", "doc_id", "size", F.coalesce("component", "id").alias("c"), F.col("component").isNotNull().alias("linked"))
    least = both.filter("linked").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = stored(both.filter("linked OR size > 1").join(least, "c", "left").select("words", F.coalesce("component_id", "doc_id").alias("component"), "size"), "named")
    key = F.when(F.col("doc_id").isNotNull(), F.col("words"))
    out = hot_lookup(all_rows.select("doc_id", "mark", "n_shingles", key.alias("words")), named, "words", "size", total)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Words are cut at ASCII white space, A-Z lower-cased; a set has the distinct runs of five words, of fewer words the
    one run that there is. Rows with the same words are one class, by digest; classes are linked at a Jaccard similarity
    of 0.75 on full sets; component_id is the smallest doc_id that links lead to. A text without words, a null text and
    a row without doc_id are linked with nothing and kept. Rows with one doc_id and different words are linked each for
    itself; rows with one doc_id and the same words have the same result.
    """
    return classified(docs).select("doc_id", "n_shingles", "component_id", "kept")


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: the smallest doc_id of each group of near duplicates.

    Rows go one by one, so that a text whose doc_id another text has too stays if nothing is similar. Of rows with one
    doc_id and the same text one stays, with all the columns of that row. Columns may have any names.
    """
    found = stored(classified(docs), "classified")
    id_, mark_, n_ = unused(docs, "id", "mark", "n")
    at = (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(docs["text"].cast("binary")) == F.col(mark_))
    gone = found.filter("NOT kept").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark_)).distinct()
    out = docs.join(gone, at, "left_anti")
    twice = stored(found.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark_)).agg(F.count("*").alias(n_)).filter(F.col(n_) > 1).drop(n_), "twice")
    if twice.isEmpty():
        return out
    return out.join(twice, at, "left_anti").unionByName(out.join(twice, at, "left_semi").dropDuplicates(["doc_id", "text"]))
