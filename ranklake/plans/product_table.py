"""Raw files to product table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ranklake.operators.products import clean_meta, merge_reviews, to_product_table, with_texts
from ranklake.operators.reviews import TOP_N_REVIEWS, aggregate_reviews
from ranklake.operators.sizing import HOT_ROWS
from ranklake.sources.tables import read_product_meta, read_reviews, write_products


def product_table(
    reviews: DataFrame, meta: DataFrame, top_n: int = TOP_N_REVIEWS, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """One row per product: metadata, its most helpful reviews, and two texts.

    The reviews are reduced to one row per product before the join.
    """
    summary = aggregate_reviews(reviews, top_n, hot_rows)
    return to_product_table(with_texts(merge_reviews(clean_meta(meta), summary)))


@dataclass(frozen=True)
class EtlCounts:
    """Rows read and written."""

    reviews: int
    meta: int
    products: int


def run_etl(
    spark: SparkSession,
    reviews_path: str,
    meta_path: str,
    output_path: str,
    top_n: int = TOP_N_REVIEWS,
) -> EtlCounts:
    """Read both raw files, write the product table, and report row counts.

    The written rows are counted by the write itself.  The reviews feed more than
    one branch of the plan, so both inputs are counted apart, without any column.
    """
    reviews = read_reviews(spark, reviews_path)
    meta = read_product_meta(spark, meta_path)
    written = Observation("products")
    products = product_table(reviews, meta, top_n).observe(
        written, F.count(F.lit(1)).alias("n")
    )
    write_products(products, output_path)
    return EtlCounts(reviews.count(), meta.count(), written.get["n"])
