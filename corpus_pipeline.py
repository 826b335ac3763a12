"""The corpus pipeline: low quality, exact and near copies and benchmark leaks go; what is left is packed.

Every stage but the last returns the columns of its documents, whatever their names: columns that an operator makes
never take the place of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import by_position, new_path, table
from quillstone.llm.decontamination import decontaminated
from quillstone.llm.exact_dedup import exact_dedup
from quillstone.llm.near_dedup import near_deduplicated
from quillstone.llm.packing import pack
from quillstone.llm.quality import fit, scored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labels, does not reject; without usable labels all stay.

    Null and empty texts are judged alike, by what the model makes of an empty text; ids don't matter.
    """
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return by_position(docs, lambda rows: scored(rows, model).filter("predicted = 1"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, A-Z lower-cased: the one with the largest doc_id; null counts as empty."""
    return by_position(docs, lambda rows: exact_dedup(rows).filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the smallest doc_id; texts without words and rows without doc_id all stay."""
    return by_position(docs, near_deduplicated)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark text; null and empty texts have none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 2048 tokens; a null text is the end token alone."""
    return pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]
#: No SQL for learned scores, hashed signatures and tokenizers: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
