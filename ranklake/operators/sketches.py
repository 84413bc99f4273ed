"""Frequent values and distinct counts per delivery, kept as sketches and combined without the rows.

A delivery adds one row per column: how many values it has, a sketch of frequent items and one of distinct items.  Rows
of any deliveries combine to those of all together.  Values are compared as text.

Errors.  Frequent items: counts are off by at most ``frequent_error`` (3.5 / capacity) of all values, and every value
above that share is listed.  Distinct items: the estimate is within ``distinct_error``
(three standard errors of 1.04 / sqrt(2 ** LG_K)) with a probability of 99.7 %.  ``profile.top_values`` and
``profile.distinct_count`` are the exact queries beside these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that the sketch of frequent items tracks, and slots of its table, the next power of two above four thirds.
TRACKED = 10_000
CAPACITY = 16_384
LG_K = 14


def frequent_error(n: int) -> float:
    return 3.5 / CAPACITY * n


def distinct_error() -> float:
    return 3 * 1.04 / 2 ** (LG_K / 2)


def accumulate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, n, frequent, distinct`` of a delivery, in one pass with partial sketches in each task."""
    parts = []
    for i, c in enumerate(columns):
        parts += [
            F.count(f"`{c}`").alias(f"n{i}"),
            F.expr(f"approx_top_k_accumulate(cast(`{c}` as string), {TRACKED})").alias(f"f{i}"),
            F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(LG_K)).alias(f"d{i}"),
        ]
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"f{i}").alias("frequent"), F.col(f"d{i}").alias("distinct"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def append(df: DataFrame, columns: Sequence[str], path: str, delivery: str) -> None:
    """Keep a delivery's sketches; one that comes again replaces its own."""
    made = accumulate(df, columns).withColumn("delivery", F.lit(delivery))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(path)


def combined(spark: SparkSession, path: str, deliveries: Sequence[str] | None = None) -> DataFrame:
    """``column_name, n, frequent, distinct`` of all deliveries, or of some."""
    kept = spark.read.parquet(path)
    if deliveries is not None:
        kept = kept.filter(F.col("delivery").isin(list(deliveries)))
    return kept.groupBy("column_name").agg(
        F.sum("n").alias("n"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def top_values(sketches: DataFrame, n: int = 10) -> DataFrame:
    """``column_name, value, n, error``: the most frequent values and how far their counts may be off."""
    listed = sketches.select("column_name", F.col("n").alias("total"), F.explode(F.expr(f"approx_top_k_estimate(frequent, {n})")).alias("v"))
    return listed.select("column_name", F.col("v.item").alias("value"), F.col("v.count").alias("n"), (F.lit(3.5 / CAPACITY) * F.col("total")).alias("error"))


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """``column_name, n_distinct, error``."""
    n = F.hll_sketch_estimate("distinct")
    return sketches.select("column_name", n.alias("n_distinct"), (n * F.lit(distinct_error())).alias("error"))
