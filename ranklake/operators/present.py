"""Text made from hits: the prompt of an answer, and result cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.text import (
    first_non_empty,
    known,
    rating_note,
    review_count_note,
    snippet,
    star_bar,
    strip,
)

# Lengths, the title of an untitled product, and the prompt wording.
CONTEXT_CHARS = 500
CARD_CHARS = 200
NO_TITLE = "Unknown product"
PROMPT_QUERY = "User query: "
PROMPT_PRODUCTS = "\n\nTop retrieved products:\n"
PROMPT_TASK = "\n\nBased only on the products above, answer the user's query in 2-3 sentences."


def build_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, prompt``: the query with its numbered hits.

    A hit shows its title, its rating if known, and the start of its content (or
    else of its reviews).  A query without hits gets a prompt with an empty list.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    text = strip(first_non_empty(F.col("content"), F.col("review_texts"), default=""))
    item = F.concat(
        F.col("item_no").cast("string"),
        F.lit(". "),
        first_non_empty(F.col("product_title"), default=NO_TITLE),
        rating_note(F.col("average_rating")),
        F.lit("\n"),
        snippet(text, CONTEXT_CHARS),
    )
    contexts = (
        hits.withColumn("item_no", F.row_number().over(order))
        .select("query_id", "item_no", item.alias("item"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("item_no", "item"))).alias("items"))
        .select("query_id", F.array_join(F.col("items.item"), "\n\n").alias("context"))
    )
    return queries.join(contexts, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit(PROMPT_QUERY),
            F.col("query"),
            F.lit(PROMPT_PRODUCTS),
            F.coalesce("context", F.lit("")),
            F.lit(PROMPT_TASK),
        ).alias("prompt"),
    )


def result_cards(hits: DataFrame) -> DataFrame:
    """The four text lines of a result card, per hit."""
    rating = known(F.col("average_rating")).cast("double")
    review = F.coalesce("review_texts", F.lit(""))
    return hits.select(
        "query_id",
        "rank",
        "parent_asin",
        first_non_empty(F.col("product_title"), default=NO_TITLE).alias("title"),
        F.when(
            rating.isNotNull(),
            F.concat(
                star_bar(rating),
                F.format_string(" %.1f ", rating),
                review_count_note(F.col("rating_number")),
            ),
        ).otherwise(F.lit("")).alias("rating_line"),
        F.when(
            review != "", F.concat(F.lit('"'), snippet(review, CARD_CHARS), F.lit('"'))
        ).otherwise(F.lit("")).alias("review_quote"),
        F.concat(
            F.format_string("Score: %.4f | ASIN: ", F.col("score")),
            F.coalesce("parent_asin", F.lit("")),
        ).alias("caption"),
    )
