"""Reviews of a product: the most helpful ones, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.operators.sizing import HOT_ROWS, hot_keys, split_hot

TOP_N_REVIEWS = 10


def usable_reviews(reviews: DataFrame) -> DataFrame:
    """``parent_asin, review_text, rating, votes`` of reviews with a text.

    Only spaces count as blank.  A missing vote count is zero.  Reviews that name
    no product are left out, as no product would join them.
    """
    return reviews.filter((F.trim("text") != "") & F.col("parent_asin").isNotNull()).select(
        "parent_asin",
        F.col("text").alias("review_text"),
        "rating",
        F.coalesce("helpful_vote", F.lit(0)).alias("votes"),
    )


def _most_helpful(*by: str) -> Window:
    """Votes first; text and rating settle ties, so that equal rows are alike."""
    return Window.partitionBy(*by).orderBy(
        F.col("votes").desc(), F.col("review_text"), F.col("rating")
    )


def _top(usable: DataFrame, top_n: int) -> DataFrame:
    return usable.withColumn("rn", F.row_number().over(_most_helpful("parent_asin"))).filter(
        F.col("rn") <= top_n
    )


def _top_salted(salted: DataFrame, top_n: int) -> DataFrame:
    """Two cuts for hot products: best rows per salt, then best rows of those."""
    first = (
        salted.withColumn("rn", F.row_number().over(_most_helpful("parent_asin", "salt")))
        .filter(F.col("rn") <= top_n)
        .drop("rn", "salt")
    )
    return _top(first, top_n)


def _split(reviews: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    # All reviews are counted, usable or not: that reads nothing but the key.
    hot = hot_keys(reviews.filter(F.col("parent_asin").isNotNull()), "parent_asin", hot_rows)
    return split_hot(
        usable_reviews(reviews), "parent_asin", hot, ["votes", "review_text", "rating"]
    )


def rank_reviews(
    reviews: DataFrame, top_n: int = TOP_N_REVIEWS, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The ``top_n`` most helpful reviews per product, numbered by ``rn``.

    The cut is applied before the shuffle as well, so a product sends at most
    ``top_n`` rows per input partition.  Hot products are salted on top of that, or nothing is counted
    where ``hot_rows`` is ``None``: the caller knows that no product has many rows.
    """
    if hot_rows is None:
        return _top(usable_reviews(reviews), top_n)
    ordinary, salted = _split(reviews, hot_rows)
    return _top(ordinary, top_n).unionByName(_top_salted(salted, top_n))


def summarize_reviews(ranked: DataFrame) -> DataFrame:
    """Texts in rank order joined by a space, and the mean rating of those reviews.

    A product has ``top_n`` rows at most here, so the collected lists are short.
    """
    in_order = F.array_sort(F.collect_list(F.struct("rn", "review_text")))
    return ranked.groupBy("parent_asin").agg(
        F.array_join(F.transform(in_order, lambda r: r["review_text"]), " ").alias("review_texts"),
        F.round(F.avg("rating"), 2).alias("avg_review_rating"),
    )


def aggregate_reviews(
    reviews: DataFrame, top_n: int = TOP_N_REVIEWS, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """One row per reviewed product.

    Each branch is summarised before the union: the summary then needs no
    shuffle beyond that of the ranking.
    """
    if hot_rows is None:
        return summarize_reviews(rank_reviews(reviews, top_n, None))
    ordinary, salted = _split(reviews, hot_rows)
    return summarize_reviews(_top(ordinary, top_n)).unionByName(
        summarize_reviews(_top_salted(salted, top_n))
    )
