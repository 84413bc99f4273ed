"""Schemas of the inputs and of the product table."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


# Raw reviews; nested image lists are left out and so never parsed into columns.
REVIEWS = _struct(
    rating=DoubleType(),
    title=StringType(),
    text=StringType(),
    asin=StringType(),
    parent_asin=StringType(),
    user_id=StringType(),
    timestamp=LongType(),
    helpful_vote=LongType(),
    verified_purchase=BooleanType(),
)

# Raw metadata.  Prices come as numbers or text, and ``details`` is an object
# with other keys in every row: both are kept as text.
PRODUCT_META = _struct(
    parent_asin=StringType(),
    title=StringType(),
    main_category=StringType(),
    average_rating=DoubleType(),
    rating_number=LongType(),
    store=StringType(),
    price=StringType(),
    features=ArrayType(StringType()),
    description=ArrayType(StringType()),
    categories=ArrayType(StringType()),
    details=StringType(),
)

PRODUCTS = _struct(
    doc_id=StringType(),
    parent_asin=StringType(),
    product_title=StringType(),
    main_category=StringType(),
    average_rating=DoubleType(),
    rating_number=LongType(),
    store=StringType(),
    price=StringType(),
    review_texts=StringType(),
    avg_review_rating=DoubleType(),
    text_bm25=StringType(),
    text_faiss=StringType(),
    details=StringType(),
)

FEEDBACK = _struct(
    timestamp=StringType(),
    query=StringType(),
    mode=StringType(),
    parent_asin=StringType(),
    title=StringType(),
    feedback=StringType(),
)
