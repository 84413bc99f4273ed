"""The two evaluation query sets as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Number, query, difficulty, judged winner.
RETRIEVAL_QUERIES = [
    (1, "wireless PS5 controller", "Easy", "BM25"),
    (2, "Nintendo Switch OLED 64GB", "Easy", "BM25"),
    (3, "Xbox Series X HDMI cable", "Easy", "BM25"),
    (4, "best god of war", "Medium", "Semantic"),
    (5, "controller that doesn't cause hand fatigue", "Medium", "BM25"),
    (6, "game for a family to play together on TV", "Medium", "Semantic"),
    (7, "headset with clear voice chat for online gaming", "Medium", "Semantic"),
    (8, "best Nintendo console under 300", "Complex", "Semantic"),
    (9, "best open world RPG under $30 with good story", "Complex", "BM25"),
    (10, "what do reviewers say about drift issues on Switch controllers", "Complex", "BM25"),
]

# Number, query, intent.
ANSWER_QUERIES = [
    (1, "wireless PS5 controller", "Easy: clear product type; checks factual grounding."),
    (2, "best god of war", "Medium: franchise name; checks that the model does not hallucinate titles."),
    (3, "party game for Switch", "Medium: category + platform; multiple valid products."),
    (4, "RPG under $30", "Hard: price constraint may be weak in snippets; checks honesty / limits."),
    (5, "PS5 controller drift", "Hard: opinion / issue; checks whether the answer stays in retrieved text."),
]


def retrieval_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RETRIEVAL_QUERIES, "query_id long, query string, difficulty string, winner string"
    )


def answer_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWER_QUERIES, "query_id long, query string, intent string")
