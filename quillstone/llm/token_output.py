"""Token ids as directly addressable codes in raw files: chunk levels, continuation bitmaps and rank directories."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, size_of
from .tokens import encoded, record_batches, tokenizer_path

MAGIC = b"QDAC2\0\0\0"
#: ids in a block of a level, and its parts: ones before it, the bitmap of ids that go on, a byte of each id.
BLOCK_IDS = 512
BLOCK = np.dtype([("rank", "<u4"), ("bits", "u1", BLOCK_IDS // 8), ("chunk", "u1", BLOCK_IDS)])
#: The end of a file: part, shard, ids before it in the part, ids, documents, levels, ids of each level, magic.
FOOTER = struct.Struct("<iiqqqi4q8s")
#: ids in one file, at least one document.
SHARD_IDS = 4_000_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def dac_encode(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, part: int = 0, shard: int = 0, first: int = 0) -> bytes:
    """A file: a level for each byte of the largest id, then where the documents end, their doc_ids, and the footer.

    A level has the next 8 bits of every id that reaches it, in blocks of equal size: each begins with the number of ids
    before it that go on to the next level, and has a bitmap of those within. So one block a level leads to any id.
    """
    parts, sizes, rest = [], [], ids.astype("<u4")
    while len(sizes) < 4 and (not sizes or len(rest)):
        more = rest > 0xFF
        blocks = np.zeros(-(-len(rest) // BLOCK_IDS), BLOCK)
        full = len(blocks) * BLOCK_IDS
        flags = np.zeros(full, bool)
        flags[: len(rest)] = more
        chunk = np.zeros(full, np.uint8)
        chunk[: len(rest)] = rest & 0xFF
        blocks["chunk"], blocks["bits"] = chunk.reshape(-1, BLOCK_IDS), np.packbits(flags, bitorder="little").reshape(-1, BLOCK_IDS // 8)
        ones = flags.reshape(-1, BLOCK_IDS).sum(1)
        blocks["rank"] = np.cumsum(ones) - ones
        parts.append(blocks.tobytes())
        sizes.append(len(rest))
        rest = rest[more] >> 8
    parts += [ends.astype("<i8").tobytes(), doc_ids.astype("<i8").tobytes()]
    return b"".join(parts) + FOOTER.pack(part, shard, first, len(ids), len(ends), len(sizes), *sizes, *[0] * (4 - len(sizes)), MAGIC)


class TokenFile:
    """Reads a file by ranges: read(offset, n) gives n bytes, size is the file's, with the line feed that Spark adds."""

    def __init__(self, read, size: int):
        self.read = read
        at = size - 1 - FOOTER.size
        self.part, self.shard, self.first, self.n, self.docs, levels, *sizes, magic = FOOTER.unpack(read(at, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.levels, offset = [], 0
        for k in range(levels):
            self.levels.append((offset, sizes[k]))
            offset += -(-sizes[k] // BLOCK_IDS) * BLOCK.itemsize
        self.documents_at = offset

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        return cls(lambda at, n: data[at : at + n], len(data))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenFile:
        """A file in any file system that Spark reaches, of which only what is asked for is read."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stream = fs.open(at)

        def read(offset: int, n: int) -> bytes:
            stream.seek(offset)
            return bytes(stream.readNBytes(n))

        return cls(read, fs.getFileStatus(at).getLen())

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, where they end)."""
        both = np.frombuffer(self.read(self.documents_at, 16 * self.docs), "<i8")
        return both[self.docs :], both[: self.docs]

    def __getitem__(self, i: int) -> int:
        """The id at place i, from one block a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (offset, _) in enumerate(self.levels):
            number, place = divmod(i, BLOCK_IDS)
            block = np.frombuffer(self.read(offset + number * BLOCK.itemsize, BLOCK.itemsize), BLOCK)[0]
            out |= int(block["chunk"][place]) << 8 * k
            more = np.unpackbits(block["bits"], bitorder="little")
            if not more[place]:
                break
            i = int(block["rank"]) + int(more[:place].sum())
        return out

    def all(self) -> np.ndarray:
        out, at = np.zeros(self.n, "<u4"), None
        for k, (offset, n) in enumerate(self.levels):
            number = -(-n // BLOCK_IDS)
            blocks = np.frombuffer(self.read(offset, number * BLOCK.itemsize), BLOCK)
            chunk = blocks["chunk"].reshape(-1)[:n]
            if at is None:
                out[:] = chunk
            else:
                out[at] |= chunk.astype("<u4") << np.uint32(8 * k)
            more = np.unpackbits(blocks["bits"].reshape(-1), count=n, bitorder="little").astype(bool)
            at = np.flatnonzero(more) if at is None else at[more]
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, drops_space: bool, shard_ids: int = SHARD_IDS) -> None:
    """Write docs (doc_id, text) in ascending doc_id order as raw files, through the file system that Spark uses for path.

    The parts are ranges of doc_id, as many as the texts' bytes call for; rows with one doc_id, or none, come in the
    order of a hash of their texts, and equal rows are spread too. A part is sorted and encoded by one task, file by
    file; rows without doc_id come first. Spark's text writer gives each file's bytes as they are and a line feed.
    """
    _, tasks = size_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("spread", F.rand(7))

    def run(batches):
        number = TaskContext.get().partitionId()
        first = shard = total = 0
        doc_ids, parts, ends = [], [], []

        def image():
            names = np.array([NO_ID if i is None else i for i in doc_ids], np.int64)
            return (dac_encode(np.frombuffer(b"".join(parts), "<u4"), np.array(ends, np.int64), names, number, shard, first),)

        def rows():
            nonlocal first, shard, total, doc_ids, parts, ends
            for doc_id, ids in encoded(batches, tokenizer, drops_space):
                doc_ids.append(doc_id)
                parts.append(ids)
                total += len(ids) // 4
                ends.append(total)
                if total >= shard_ids:
                    yield image()
                    first, shard, total = first + total, shard + 1, 0
                    doc_ids, parts, ends = [], [], []
            if doc_ids:
                yield image()

        yield from record_batches(rows(), pa.schema([("image", pa.binary())]), 1)

    dealt = rows.repartitionByRange(tasks, "doc_id", "hash", "spread").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    images = dealt.mapInArrow(run, "image binary").select(F.col("image").cast("string"))
    images.write.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the token files; a part without documents may have left an empty one."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 1").select("path", "content")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, shard, first, n_ids) of each file: first ids of its part come before it."""

    def run(batches):
        for batch in batches:
            found = [TokenFile.of(memoryview(c.as_buffer())) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(f, x) for f in found], t) for x, t in (("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int64())))], ["path", "part", "shard", "first", "n_ids"])

    return files_of(spark, path).mapInArrow(run, "path string, part int, shard int, first long, n_ids long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    sizes = {r[0]: r[1] for r in token_index(spark, path).groupBy("part").agg(F.sum("n_ids")).collect()}  # one row a part
    before, at = {}, 0
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]

    def run(batches):
        def rows():
            for batch in batches:
                for content in batch.column(1):
                    file = TokenFile.of(memoryview(content.as_buffer()))
                    raw = memoryview(file.all().tobytes())
                    start = before[file.part] + file.first
                    last = 0
                    for doc_id, end in zip(*(x.tolist() for x in file.documents())):
                        yield None if doc_id == NO_ID else doc_id, start + last, end - last, zlib.crc32(raw[4 * last : 4 * end])
                        last = end

        yield from record_batches(rows(), _OUT, 5000)

    return files_of(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, drops_space: bool = True, path: str | None = None) -> DataFrame:
    """Write the ids of docs and read the files back: one row per document.

    A null text counts as empty: such a document has the end id alone. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path("word_bpe_49k.json"), drops_space)
    return read_tokens(spark, path)
