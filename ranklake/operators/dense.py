"""Exact vector search in batch.

The score is the squared Euclidean distance, smaller is better.  A task turns
the vectors it reads into matrices, and keeps for every query only the best
``k`` so far; no (query, vector) pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ranklake.operators.sizing import BROADCAST_BYTES, Size, measure
from ranklake.operators.topk import CELLS, QUERIES_AT_ONCE, BestPerQuery, id_array, true_cells

SCORE_DIGITS = 6

#: Squared lengths from which on single precision might overflow.
SINGLE_MAX = 1e30
#: Vectors of a block at least, where blocks are made smaller to give each core several pairs of them.
BLOCK_ROWS = 4096


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    keys: Sequence[str] = ("query_id",),
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Nearest ``k`` vectors per query: ``<keys>, doc_id, rank, score``.

    ``vectors`` holds ``doc_id, embedding`` and ``queries`` the keys and
    ``embedding``.  Equal (rounded) distances are ordered by ``doc_id``.

    The queries are measured.  Within ``limit`` they go to every task and the
    vectors are not shuffled; beyond it both sides are divided into blocks of
    bounded size, and each pair of blocks is one task's work.  A vector whose
    length differs from the queries' or that has a null item is an error.
    """
    keys = list(keys)
    vectors = vectors.select("doc_id", "embedding").filter(F.col("embedding").isNotNull())
    queries = queries.select(*keys, "embedding").filter(F.col("embedding").isNotNull())
    size = measure(queries, 8 * F.size("embedding") + 32 * len(keys))
    schema = StructType(
        [queries.schema[key] for key in keys]
        + [vectors.schema["doc_id"], StructField("score", DoubleType())]
    )
    if size.fits(limit):
        best = _search_broadcast(vectors, queries, k, keys, schema)
    else:
        best = _search_blocks(vectors, queries, k, keys, schema, size, limit)
    nearest = Window.partitionBy(*keys).orderBy(F.col("score"), F.col("doc_id"))
    return (
        best.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select(*keys, "doc_id", "rank", "score")
    )


def _search_broadcast(vectors, queries, k, keys, schema) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(queries.toArrow())

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if table.num_rows == 0:
            return
        matrix = _matrix(table.column("embedding"), table.column(keys[0]))
        best = BestPerQuery(table.num_rows, k)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("embedding"), batch.column("doc_id"), matrix.shape[1])
                _nearest(best, matrix, vectors, id_array(batch.column("doc_id")))
        yield from best.table(table, keys, "score").to_batches()

    return vectors.mapInArrow(nearest, schema)


def _search_blocks(vectors, queries, k, keys, schema, size: Size, limit) -> DataFrame:
    vector_size = measure(vectors, 8 * F.size("embedding") + 32)
    q_blocks = size.parts(limit)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # Few large pairs of blocks would leave cores without one.
    v_blocks = max(vector_size.parts(limit), min(-(-4 * cores // q_blocks), vector_size.rows // BLOCK_ROWS))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = vectors.withColumn(
        "v_block", F.pmod(F.xxhash64("doc_id", "embedding"), F.lit(v_blocks)).cast("int")
    ).withColumn("q_block", every(q_blocks))
    right = queries.withColumn(
        "q_block", F.pmod(F.xxhash64(*keys, "embedding"), F.lit(q_blocks)).cast("int")
    ).withColumn("v_block", every(v_blocks))

    def nearest(block: pa.Table, wanted: pa.Table) -> pa.Table:
        best = BestPerQuery(wanted.num_rows, k)
        if wanted.num_rows and block.num_rows:
            matrix = _matrix(wanted.column("embedding"), wanted.column(keys[0]))
            vectors = _matrix(block.column("embedding"), block.column("doc_id"), matrix.shape[1])
            _nearest(best, matrix, vectors, id_array(block.column("doc_id")))
        found = best.table(wanted, keys, "score")
        # Without any hit the ids have no type of their own.
        place = found.schema.get_field_index("doc_id")
        return found.set_column(place, "doc_id", found.column(place).cast(block.schema.field("doc_id").type))

    return (
        left.groupBy("q_block", "v_block")
        .cogroup(right.groupBy("q_block", "v_block"))
        .applyInArrow(nearest, schema)
    )


def _matrix(column, ids, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as a float64 matrix of ``dims`` columns (default: those of the first row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if dims is None:
        dims = int(lengths[0]) if len(lengths) else 0
    odd = np.flatnonzero(lengths != dims)
    if len(odd):
        raise ValueError(f"vector {ids[int(odd[0])]} has {lengths[odd[0]]} numbers, expected {dims}")
    numbers = column.flatten()
    if numbers.null_count:
        at = int(np.flatnonzero(numbers.is_null().to_numpy(zero_copy_only=False))[0]) // dims
        raise ValueError(f"vector {ids[at]} has a null item")
    return numbers.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _nearest(best: BestPerQuery, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
    """Offer ``vectors`` to ``best``, some queries and some vectors at a time.

    A matrix product only picks, with a margin above its error, the pairs whose distance is then taken from the
    differences.  It is one of single precision where its margin leaves few pairs, else one of double precision, which
    loses digits only where norms are large against distances.
    """
    if best.k <= 0 or not len(vectors):
        return
    dims = queries.shape[1]
    step = max(1, CELLS // max(1, min(len(queries), QUERIES_AT_ONCE)))
    block = max(1, CELLS // max(1, dims))
    squares, lengths = ((rows * rows).sum(axis=1) for rows in (queries, vectors))
    single = len(queries) > 0 and max(squares.max(), lengths.max()) < SINGLE_MAX  # False for what is not finite
    if single:
        right = np.concatenate([vectors, lengths[:, None]], axis=1, dtype=np.float32, casting="same_kind")
        cells, hits = np.empty(min(len(queries), QUERIES_AT_ONCE) * step, np.float32), np.empty(min(len(queries), QUERIES_AT_ONCE) * step, bool)
    for first in range(0, len(queries), QUERIES_AT_ONCE):
        some, square = (rows[first : first + QUERIES_AT_ONCE] for rows in (queries, squares))
        if single:
            left = np.concatenate([-2.0 * some, np.ones((len(some), 1))], axis=1, dtype=np.float32, casting="same_kind")
        held, n_held = [], 0
        for start in range(0, len(vectors), step):
            part, length = (rows[start : start + step] for rows in (vectors, lengths))
            edge, picked = best.edge[first : first + len(some)], None
            if single:
                picked = _picked_single(left, right[start : start + step], square, length, edge, best.k, cells, hits)
                single = picked is not None
            query, column = picked or _picked_double(some, part, square, length, edge, best.k)
            distance = np.empty(len(query))
            for lo in range(0, len(query), block):
                q, c = query[lo : lo + block], column[lo : lo + block]
                distance[lo : lo + block] = np.round(((some[q] - part[c]) ** 2).sum(axis=1), SCORE_DIGITS)
            held.append((query + first, distance, ids[start : start + step][column]))
            n_held += len(query)
            # Those kept are sorted with each offer, so it waits until there is about half as many new ones.
            if np.isinf(edge).any() or 2 * n_held >= best.k * len(some) or start + step >= len(vectors):
                best.offer(*(np.concatenate(c) for c in zip(*held)), first)
                held, n_held = [], 0


def _picked_double(queries, vectors, square, length, edge, k) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that may be among the best ``k`` or reach ``edge``."""
    scale = square[:, None] + length[None, :]
    rough = scale - 2.0 * (queries @ vectors.T)
    margin = (4 * (queries.shape[1] + 4) * np.finfo(np.float64).eps) * scale + 10.0**-SCORE_DIGITS
    kth = min(k, len(vectors)) - 1
    least = np.partition(rough + margin, kth, axis=1)[:, kth]
    return np.nonzero(rough - margin <= np.minimum(least, edge)[:, None])


def _picked_single(left, right, square, length, edge, k, cells, hits) -> tuple[np.ndarray, np.ndarray] | None:
    """The same from rows with the squared length as one more column; none where too many pairs are left.

    The product is the distance less the query's squared length.  The ``k``-th smallest is looked for only where ``edge``
    leaves many pairs.
    """
    shape, n = (len(left), len(right)), len(left) * len(right)
    rough, hit = cells[:n].reshape(shape), hits[:n].reshape(shape)
    np.matmul(left, right.T, out=rough)
    margin = (4 * (left.shape[1] + 4) * np.finfo(np.float32).eps) * (square + length.max()) + 10.0**-SCORE_DIGITS
    reach, few = edge - square + margin, 4 * k * len(left) + 64
    for tighter in (False, True):
        if tighter:
            kth = min(k, len(right)) - 1
            reach = np.minimum(reach, np.partition(rough, kth, axis=1)[:, kth] + 2 * margin)
        elif np.isinf(edge).any():
            continue
        np.less_equal(rough, np.nextafter(reach.astype(np.float32), np.float32(np.inf))[:, None], out=hit)
        near = true_cells(hit)
        if len(near) <= few:
            break
    return None if len(near) > max(few, n // 16) else np.divmod(near, len(right))
