"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet and read again as the next one's documents.  All but the last return the columns of
documents.  A document without an id is kept by every stage that can't name it; near_duplicates names
rows by id and text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm import decontaminate as leaks
from ranklake.llm import line_dedup as lines
from ranklake.llm import ngram_join, packing, quality_cnn
from ranklake.llm.queries import tokenizer_path
from ranklake.session import ship
from ranklake.sources.storage import stored

#: Some stages' results can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def _shipped(stage: Callable) -> Callable:
    """The stage for sessions whose workers may not have this library yet."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects (a score below one half)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = quality_cnn.fit(docs, labels, usable)
    return quality_cnn.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines; a document that loses all its text goes."""
    return lines.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies."""
    return ngram_join.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", _shipped(quality)),
    ("line_dedup", _shipped(line_dedup)),
    ("near_duplicates", _shipped(near_duplicates)),
    ("decontaminate", _shipped(decontaminate)),
    ("pack", _shipped(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
