"""Passage tables: one text column as ``content``, the rest as metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.operators.sizing import measure
from ranklake.sources.storage import stored

# The two text columns of a product, and the metadata of a passage.
TEXT_COLUMNS = ("text_bm25", "text_faiss")
META_COLUMNS = (
    "doc_id",
    "parent_asin",
    "product_title",
    "average_rating",
    "rating_number",
    "review_texts",
)


def to_passages(products: DataFrame, text_column: str) -> DataFrame:
    """``content`` from one text column; the other text column is dropped.

    A NULL text becomes the empty text.
    """
    others = [c for c in TEXT_COLUMNS if c != text_column]
    content = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("content")
    rest = products.drop(*others, text_column)
    return products.select(content, *rest.columns)


def build_dual_corpora(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lexical and the vector corpus of the same products."""
    return tuple(to_passages(products, column) for column in TEXT_COLUMNS)


def with_metadata(products: DataFrame, text_column: str) -> DataFrame:
    """One text column and the metadata columns, as an index build reads them."""
    return products.select(text_column, *META_COLUMNS)


def duplicate_ids(passages: DataFrame) -> DataFrame:
    """``doc_id, n`` of ids that occur more than once."""
    return passages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def enrich(hits: DataFrame, passages: DataFrame, columns: list[str]) -> DataFrame:
    """Set ``columns`` of each hit from the passage with its id.

    Ids are compared as text.  A hit without a passage keeps what it has.  Of
    several passages with one id, the greatest (by the listed columns) is used.

    The hits are written to shared storage first, since they are read twice, and
    their distinct ids are measured.  Ids that fit are broadcast, so the passages
    are filtered where they lie and only passages named by a hit are shuffled.
    """
    hits = stored(hits, "hits")
    ids = (
        hits.select(F.col("doc_id").cast("string").alias("_id"))
        .filter(F.col("_id").isNotNull())
        .distinct()
    )
    if measure(ids, F.octet_length("_id")).fits():
        ids = F.broadcast(ids)
    wanted = (
        passages.select(F.col("doc_id").cast("string").alias("_id"), F.struct(*columns).alias("_found"))
        .join(ids, "_id", "left_semi")
        .groupBy("_id")
        .agg(F.max("_found").alias("_found"))
    )
    joined = hits.withColumn("_id", F.col("doc_id").cast("string")).join(wanted, "_id", "left")
    kept = [c for c in hits.columns if c not in columns]
    filled = [
        F.when(F.col("_found").isNotNull(), F.col(f"_found.{c}"))
        .otherwise(F.col(c) if c in hits.columns else F.lit(None))
        .alias(c)
        for c in columns
    ]
    return joined.select(*kept, *filled)
