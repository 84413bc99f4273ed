"""Second-stage scoring of retrieved passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.models import ScoreFactory, pair_score

# Fixed value: how many hits are retrieved for re-scoring.
DEFAULT_RERANK_POOL = 15


def rerank(hits: DataFrame, queries: DataFrame, top_k: int, scorer: ScoreFactory) -> DataFrame:
    """Best ``top_k`` hits per query by the scorer.

    Each ``content`` is scored against the original ``query`` of its
    ``query_id``.  ``score`` becomes the new score, ``retrieval_score`` keeps the
    old one, and equal scores keep their former order.
    """
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_prior"))
    scored = (
        hits.join(queries.select("query_id", F.col("query").alias("_query")), "query_id")
        .withColumn("retrieval_score", F.col("score"))
        .withColumn("_prior", F.col("rank"))
        .withColumn("score", pair_score(F.col("_query"), F.col("content"), scorer))
    )
    return (
        scored.withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= top_k)
        .select(*hits.columns, "retrieval_score")
    )
