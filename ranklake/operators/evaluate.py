"""Comparison of retrieval modes over a query set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mode_overlap(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``query_id, n_left, n_right, n_both``: the first ``k`` hits of two modes."""
    def first(hits: DataFrame, in_left: bool) -> DataFrame:
        return hits.filter(F.col("rank") <= k).select(
            "query_id", "doc_id", F.lit(in_left).alias("l"), F.lit(not in_left).alias("r")
        )

    documents = (
        first(left, True)
        .unionByName(first(right, False))
        .groupBy("query_id", "doc_id")
        .agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    )
    return documents.groupBy("query_id").agg(
        F.count_if("l").alias("n_left"),
        F.count_if("r").alias("n_right"),
        F.count_if(F.col("l") & F.col("r")).alias("n_both"),
    )


def judged_wins(judgements: DataFrame) -> DataFrame:
    """``difficulty, winner, n``: human verdicts counted per difficulty."""
    return judgements.groupBy("difficulty", "winner").agg(F.count(F.lit(1)).alias("n"))


def compare_modes(overlap: DataFrame, judgements: DataFrame) -> DataFrame:
    """Overlap per query together with its difficulty and judged winner, if any."""
    return overlap.join(
        judgements.select("query_id", "difficulty", "winner"), "query_id", "left"
    )
