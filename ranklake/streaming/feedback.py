"""Votes as a stream into an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ranklake.sources.feedback import feedback_rows

#: How long after an event a repetition of it is known as such.
DELAY = "7 days"


def ingest_feedback(votes: DataFrame, path: str, checkpoint: str, event_id: str | None = None, delay: str = DELAY) -> StreamingQuery:
    """Append the votes that are new since the last run, then stop.

    The checkpoint records which input files were taken, so a restart neither
    loses nor repeats a row.  With ``event_id``, an event that is delivered again is written once: ids
    are kept as state until events are ``delay`` later than them (by ``at``), so the state is bounded by the events
    of that time.  What comes later than that is left out, as it can't be told from a repetition.
    """
    if event_id is not None:
        # Events that are no votes need no state.
        votes = votes.filter(F.col("feedback").isNotNull()).withWatermark("at", delay).dropDuplicatesWithinWatermark([event_id])
    rows = feedback_rows(votes, F.col("at")) if "at" in votes.columns else votes
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
