"""The append-only log of votes on results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.functions.text import utc_iso
from ranklake.sources.schemas import FEEDBACK

# The two votes.
VOTES = ("up", "down")


def feedback_rows(votes: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Rows of the log: six text columns, time as ISO text in UTC.

    Rows whose ``feedback`` is neither ``up`` nor ``down`` are left out.
    """
    at = F.current_timestamp() if timestamp is None else timestamp
    texts = [F.col(c).cast("string").alias(c) for c in FEEDBACK.fieldNames()[1:]]
    return votes.select(utc_iso(at).alias("timestamp"), *texts).filter(
        F.col("feedback").isin(*VOTES)
    )


def append_feedback(rows: DataFrame, path: str) -> None:
    """Append to a CSV log; every part file carries the header line."""
    rows.write.mode("append").option("header", "true").option("quoteAll", "true").csv(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(FEEDBACK)
        .option("header", "true")
        .option("multiLine", "true")
        .option("escape", "\\")
        .csv(path)
    )
