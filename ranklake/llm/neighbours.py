"""Each document with the next one in descending order of id, whole texts shuffled once.

Documents are dealt into buckets of consecutive ids.  The first document of a bucket is also sent to
the bucket before it, and that of the first bucket to the last one, so every pair of neighbours meets
in one task, which streams over its sorted rows.

Equal ids are ordered by a hash of their text; a null id comes last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket, and the most buckets, whose bounds the driver holds.
BUCKET_ROWS = 4_000
MAX_BUCKETS = 20_000

_LEAST = -(1 << 63)


def with_next(docs: DataFrame, per_pairs: Callable, schema: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``per_pairs(ids, texts, next_texts)`` of every document, as batches of ``schema``.

    It gets lists of ids and texts (bytes; null is empty) of consecutive documents, ``texts`` one longer
    where the last document's next one follows it, and returns a record batch.
    """
    source = docs.select(
        F.col(id).cast("long").alias("id"),
        F.coalesce(F.col(id).cast("long"), F.lit(_LEAST)).alias("k"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    rows = source.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = min(MAX_BUCKETS, max(1, math.ceil(rows / BUCKET_ROWS)))
    cuts = [i / n for i in range(1, n)]
    bounds = source.agg(F.percentile_approx("k", F.array(*map(F.lit, cuts)), 10 * MAX_BUCKETS)).first()[0] if cuts and rows else []
    bounds = np.array(sorted(set(bounds)), np.int64)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        # Descending: the largest ids are in bucket 0.
        return pd.Series((len(bounds) - np.searchsorted(bounds, k.to_numpy(), "left")).astype(np.int32))

    heads = sorted((r["b"], r["k"]) for r in source.select("k", bucket("k").alias("b")).groupBy("b").agg(F.max("k").alias("k")).collect())
    # The bucket before each one; the one before the first is the last.
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}

    @F.pandas_udf("int")
    def also(k: pd.Series) -> pd.Series:
        return k.map(lambda x: before.get(x, -1)).astype("int32")

    there = F.array(F.struct(F.col("b"), F.lit(0).alias("ahead")), F.struct(F.col("also").alias("b"), F.lit(1).alias("ahead")))
    dealt = (
        source.withColumns({"b": bucket("k"), "also": also("k")})
        .withColumn("to", F.explode(F.when(F.col("also") < 0, F.slice(there, 1, 1)).otherwise(there)))
        .select("id", "k", "text", "to.b", "to.ahead")
    )
    ordered = dealt.repartition(len(heads) or 1, "b").sortWithinPartitions("b", "ahead", F.desc("k"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        at, closed, held = None, False, 0

        def close(last: bytes | None):
            nonlocal ids, texts, held
            done = per_pairs(ids, texts, texts[1:] + ([last] if last is not None else []))
            ids, texts, held = [], [], 0
            return done

        for batch in batches:
            for i, t, b, ahead in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "b", "ahead"))):
                if b != at:
                    at, closed = b, False
                if ahead:
                    # The first of the next bucket completes this one; rows of the same id may follow.
                    if not closed and ids:
                        yield close(t)
                    closed = True
                    continue
                if held > 1 << 20 and len(ids) > 1:
                    yield close(t)
                ids.append(i)
                texts.append(t)
                held += len(t)
        assert not ids

    return ordered.select("id", "text", "b", "ahead").mapInArrow(run, schema)
