"""Product metadata: cleaning, joining with reviews, and the two text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.functions.text import blank_to, joined
from ranklake.operators.sizing import HOT_ROWS, hot_keys, replicate_hot, split_hot

PRODUCT_COLUMNS = (
    "doc_id",
    "parent_asin",
    "product_title",
    "main_category",
    "average_rating",
    "rating_number",
    "store",
    "price",
    "review_texts",
    "avg_review_rating",
    "text_bm25",
    "text_faiss",
    "details",
)


def clean_meta(meta: DataFrame) -> DataFrame:
    """Typed scalars, lists as text, defaults for missing prices and features."""
    return meta.select(
        "parent_asin",
        F.col("title").alias("product_title"),
        "main_category",
        F.col("average_rating").cast("double").alias("average_rating"),
        "rating_number",
        "store",
        blank_to(F.trim(F.col("price").cast("string")), "unknown").alias("price"),
        joined(F.col("features"), "no features listed").alias("features"),
        joined(F.col("description"), "").alias("description"),
        joined(F.col("categories"), "").alias("categories"),
        F.col("details").cast("string").alias("details"),
    )


def merge_reviews(meta: DataFrame, review_summary: DataFrame) -> DataFrame:
    """All products; without reviews the text is empty and the mean rating NULL."""
    return meta.join(review_summary, "parent_asin", "left").withColumn(
        "review_texts", F.coalesce("review_texts", F.lit(""))
    )


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_texts(merged: DataFrame) -> DataFrame:
    """Add the keyword rendering and the narrative rendering.

    A NULL title makes both NULL, as concatenation does.
    """
    # The labelled lines of the keyword rendering.
    lines = [
        ("Product ID: ", F.col("parent_asin")),
        ("Category: ", _text("main_category")),
        ("Seller: ", _text("store")),
        ("Categories: ", F.col("categories")),
        ("Product title: ", F.col("product_title")),
        ("Features: ", F.col("features")),
        ("Description: ", F.col("description")),
        ("Average rating: ", _text("average_rating")),
        ("Number of ratings: ", _text("rating_number")),
        ("Price: ", F.col("price")),
        ("Customer reviews: ", F.col("review_texts")),
    ]
    keywords = F.concat(
        *[part for label, value in lines for part in (F.lit(label), value, F.lit("\n"))]
    )
    # The wording of the narrative rendering.
    description = F.when(
        F.col("description") != "", F.concat(F.lit("Description: "), F.col("description"), F.lit(" "))
    ).otherwise(F.lit(""))
    narrative = F.concat(
        F.lit("Product: "), F.col("product_title"),
        F.lit(". Sold by "), _text("store"),
        F.lit(". Categories: "), F.col("categories"), F.lit(". "),
        description,
        F.lit("Features: "), F.col("features"),
        F.lit(". Rating: "), _text("average_rating"),
        F.lit(" from "), _text("rating_number"),
        F.lit(" ratings. Price: "), F.col("price"),
        F.lit(". Customer reviews: "), F.col("review_texts"),
    )
    return merged.withColumn("text_bm25", keywords).withColumn("text_faiss", narrative)


def to_product_table(with_text: DataFrame) -> DataFrame:
    """The thirteen columns of the product table; ``doc_id`` is the MD5 of the product id."""
    return with_text.withColumn("doc_id", F.md5("parent_asin")).select(*PRODUCT_COLUMNS)


def join_all_reviews(meta: DataFrame, reviews: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every product with every one of its reviews; products without any are kept.

    The reviews of a hot product are spread over salts, with a copy of the
    product for each.
    """
    reviews = reviews.filter(F.col("parent_asin").isNotNull())
    hot = hot_keys(reviews, "parent_asin", hot_rows)
    spread = [c for c in reviews.columns if c != "parent_asin"]
    ordinary, salted = split_hot(reviews, "parent_asin", hot, spread)
    # Hot products have reviews, so only the others can be without.
    rest = meta.join(F.broadcast(hot), "parent_asin", "left_anti").join(ordinary, "parent_asin", "left")
    return rest.unionByName(replicate_hot(meta, "parent_asin", hot).join(salted, ["parent_asin", "salt"]).drop("salt"))
