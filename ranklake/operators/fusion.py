"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the constant added to every rank.
RRF_K = 60

SCORE_DIGITS = 12


def fusion_key(doc_id: Column, parent_asin: Column | None = None) -> Column:
    """``doc:<id>`` for a non-blank id, else ``asin:<asin>``, else NULL."""
    doc_id = doc_id.cast("string")
    key = F.when(
        F.regexp_like(doc_id, F.lit(r"(?U)[^\s\x1c-\x1f]")), F.concat(F.lit("doc:"), doc_id)
    )
    if parent_asin is not None:
        key = key.when(parent_asin != "", F.concat(F.lit("asin:"), parent_asin))
    return key


def as_list(hits: DataFrame, list_no: int) -> DataFrame:
    """Hits as list number ``list_no`` of a fusion."""
    return hits.withColumn("list_no", F.lit(list_no))


def rrf_fuse(lists: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Fuse the ranked lists of every ``by`` group into one list.

    ``lists`` holds the ``by`` columns, ``list_no``, ``rank`` (position in its
    list), ``doc_id``, maybe ``parent_asin``, and any other columns of a hit.
    Those are kept from the first sighting of a document: lowest list, then
    lowest rank; that order also settles equal scores.  A document twice in one
    list counts twice.  Rows without a key are left out, their positions stay used.
    """
    by = list(by)
    parent = F.col("parent_asin") if "parent_asin" in lists.columns else None
    carried = [c for c in lists.columns if c not in {*by, "list_no", "rank", "score"}]
    seen = F.struct("list_no", "rank")
    fused = (
        lists.withColumn("key", fusion_key(F.col("doc_id"), parent))
        .filter(F.col("key").isNotNull())
        .groupBy(*by, "key")
        .agg(
            F.round(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))), SCORE_DIGITS).alias("score"),
            F.min(seen).alias("first_seen"),
            F.min_by(F.struct(*carried), seen).alias("hit"),
        )
    )
    best_first = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("first_seen"))
    return fused.withColumn("rank", F.row_number().over(best_first)).select(
        *by, "hit.*", "rank", "score"
    )
