"""Approximate vector search by inverted lists: vectors by their nearest centroid, some lists read for a query.

Centroids are fitted by k-means on a sample of at most ``SAMPLE`` vectors, on the driver; every vector is
then written to the list of its nearest centroid, a folder of the table.  A query reads the ``probes`` lists whose centroids are
nearest to it, and distances there are exact, so probing all lists gives the exact answer.  Which lists any query of a
batch wants is known before the vectors are read, and the other folders are skipped.

A list may be of any size (copies of one vector all lie in one): its files are read by several tasks, each of which keeps
the best ``k`` for the queries that probe the list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ranklake.operators import dense
from ranklake.operators.sizing import BROADCAST_BYTES, stored_and_measured
from ranklake.operators.topk import BestPerQuery, id_array

#: Vectors that the centroids are fitted on, centroids, and passes over the sample.
SAMPLE = 65_536
MAX_LISTS = 4096
PASSES = 12
#: Distances to centroids that are held at once.
ORDER_CELLS = 500_000
#: Share of the nearest vectors that the lists read by default are to hold, as estimated on so many of the sample.
TARGET = 0.95
TRIED, TRIED_K = 256, 10


@dataclass(frozen=True)
class ListIndex:
    """``vectors(list, doc_id, embedding)`` in folders by list, the centroids, one row a list, and how many lists to read."""

    vectors: DataFrame
    centroids: np.ndarray
    probes: int


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids * centroids).sum(1)[None, :]


def _in_order(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row; of equally near ones the first."""
    step = max(1, ORDER_CELLS // len(centroids))
    parts = [_least(_distances(rows[lo : lo + step], centroids), n) for lo in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros((0, n), np.int64)


def _least(distances: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` least distances of each row, NaN last."""
    if n != 1:
        # A copy, or all places would be kept for the first ones.
        return np.argsort(distances, axis=1, kind="stable")[:, :n].copy()
    first = np.argmin(distances, axis=1)
    odd = np.isnan(np.take_along_axis(distances, first[:, None], axis=1)[:, 0])
    first[odd] = np.argsort(distances[odd], axis=1, kind="stable")[:, 0]
    return first[:, None]


def fit_centroids(sample: np.ndarray, n_lists: int, passes: int = PASSES) -> np.ndarray:
    """K-means from distinct vectors of the sample; lists that run empty begin anew at the vectors farthest off."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(7)
    centroids = distinct[rng.permutation(len(distinct))[: max(1, n_lists)]].copy()
    for _ in range(passes):
        own = _in_order(sample, centroids, 1)[:, 0]
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        kept = counts > 0
        centroids[kept] = sums[kept] / counts[kept, None]
        empty = np.flatnonzero(~kept)
        if len(empty):
            far = np.argsort(-((sample - centroids[own]) ** 2).sum(1), kind="stable")[: len(empty)]
            centroids[empty[: len(far)]] = sample[far]
    return centroids


def needed_probes(sample: np.ndarray, centroids: np.ndarray, target: float = TARGET) -> int:
    """How many lists hold ``target`` of the nearest other vectors, by some vectors of the sample."""
    tried = sample[: min(TRIED, len(sample))]
    k = min(TRIED_K, len(sample) - 1)
    if k < 1:
        return 1
    # Itself is the nearest, or a copy of it.
    near = _in_order(tried, sample, k + 1)[:, 1:]
    own = _in_order(sample, centroids, 1)[:, 0]
    order = np.argsort(_in_order(tried, centroids, len(centroids)), axis=1)
    places = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1


def build_lists(vectors: DataFrame, path: str, n_lists: int | None = None, sample: int = SAMPLE) -> ListIndex:
    """Write the index of ``vectors(doc_id, embedding)``; rows without a vector are left out.

    ``n_lists`` is by default the square root of the number of vectors, ``MAX_LISTS`` at most.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("doc_id", "embedding").filter(F.col("embedding").isNotNull())
    n = vectors.count()
    n_lists = n_lists or min(MAX_LISTS, max(1, round(n**0.5)))
    # The same vectors on every run, wherever rows lie.
    drawn = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(sample, max(1, n))).toArrow()
    rows = dense._matrix(drawn.column("embedding"), drawn.column("doc_id"))
    centroids = fit_centroids(rows, n_lists) if len(rows) else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = dense._matrix(batch.column("embedding"), batch.column("doc_id"), shared.value.shape[1])
            yield batch.append_column("list", pa.array(_in_order(matrix, shared.value, 1)[:, 0].astype(np.int32)))

    schema = StructType([*vectors.schema.fields, StructField("list", IntegerType())])
    placed = vectors.mapInArrow(assign, schema)
    placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    shared.destroy()
    probes = needed_probes(rows, centroids) if len(rows) else 1
    named = [(i, c.tolist(), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(named, "list int, centroid array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centroids")
    return ListIndex(spark.read.schema(schema).parquet(f"{path}/vectors"), centroids, probes)


def load_lists(spark: SparkSession, path: str) -> ListIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return ListIndex(spark.read.parquet(f"{path}/vectors"), np.array([r["centroid"] for r in rows], np.float64), rows[0]["probes"])


def search(
    index: ListIndex,
    queries: DataFrame,
    k: int,
    *,
    probes: int | None = None,
    keys: Sequence[str] = ("query_id",),
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Nearest ``k`` vectors per query in its ``probes`` nearest lists: ``<keys>, doc_id, rank, score``.

    Ties and scores are those of the exact search.  The queries are measured; beyond ``limit`` they are divided
    into parts that fit, each of which reads its own lists.
    """
    keys, n_lists = list(keys), len(index.centroids)
    probes = min(n_lists, probes if probes is not None else index.probes)
    queries = queries.select(*keys, "embedding").filter(F.col("embedding").isNotNull())
    places = 4 * probes if probes < n_lists else 4
    held, size = stored_and_measured(queries, "query_vectors", 8 * F.size("embedding") + places + 32 * len(keys))
    schema = StructType([queries.schema[key] for key in keys] + [index.vectors.schema["doc_id"], StructField("score", DoubleType())])
    parts = size.parts(limit)
    part_no = F.pmod(F.xxhash64(*keys, "embedding"), F.lit(parts))
    best = None
    for i in range(parts):
        found = _in_lists(index, held.filter(part_no == i) if parts > 1 else held, k, keys, probes, schema)
        best = found if best is None else best.unionByName(found)
    nearest = Window.partitionBy(*keys).orderBy(F.col("score"), F.col("doc_id"))
    return best.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select(*keys, "doc_id", "rank", "score")


def _in_lists(index: ListIndex, queries: DataFrame, k: int, keys: list[str], probes: int, schema: StructType) -> DataFrame:
    """The best ``k`` of each task's vectors for the queries that probe their lists."""
    table = queries.toArrow()
    matrix = dense._matrix(table.column("embedding"), table.column(keys[0]), index.centroids.shape[1] if table.num_rows else 0)
    by_list = _by_list(matrix, index.centroids, probes) if table.num_rows else {}
    shared = queries.sparkSession.sparkContext.broadcast((table.select(keys), matrix, by_list))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, by_list = shared.value
        best: dict[int, BestPerQuery] = {}
        for batch in batches:
            lists = batch.column("list").to_numpy(zero_copy_only=False)
            for c in np.unique(lists).tolist():
                rows = batch.filter(pa.array(lists == c))
                if c not in best:
                    # Files hold one list each, so a task has few at a time; what it had is done.
                    for other in list(best):
                        yield from _found(best.pop(other), names, by_list[other], keys)
                    best[c] = BestPerQuery(len(by_list[c]), k)
                vectors = dense._matrix(rows.column("embedding"), rows.column("doc_id"), queries.shape[1])
                dense._nearest(best[c], queries[by_list[c]], vectors, id_array(rows.column("doc_id")))
        for c, own in best.items():
            yield from _found(own, names, by_list[c], keys)

    wanted = index.vectors.filter(F.col("list").isin(list(by_list))) if by_list else index.vectors.filter(F.lit(False))
    return wanted.select("doc_id", "embedding", "list").mapInArrow(nearest, schema)


def _by_list(matrix: np.ndarray, centroids: np.ndarray, probes: int) -> dict[int, np.ndarray]:
    """The queries that probe a list, by list."""
    if probes >= len(centroids):
        # One array for all lists: it goes to the tasks once, not once a list.
        return dict.fromkeys(range(len(centroids)), np.arange(len(matrix), dtype=np.int32))
    probed = _in_order(matrix, centroids, probes).astype(np.int32).ravel()
    order = np.argsort(probed, kind="stable")
    lists, begins = np.unique(probed[order], return_index=True)
    return dict(zip(lists.tolist(), np.split((order // max(1, probes)).astype(np.int32), begins[1:])))


def _found(best: BestPerQuery, names: pa.Table, own: np.ndarray, keys: list[str]) -> list[pa.RecordBatch]:
    if best.doc is None:
        return []
    return best.table(names.take(pa.array(own)), keys, "score").to_batches()


def recall(found: DataFrame, exact: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """``n_exact, n_found, recall``: how many of the exact hits were found.

    Vectors as near as an exact hit count for it, as ties may fall either way.
    """
    worst = exact.groupBy(*keys).agg(F.max("score").alias("edge"), F.count(F.lit(1)).alias("n"))
    near = found.join(worst, list(keys)).filter(F.col("score") <= F.col("edge"))
    n_found = near.agg(F.count(F.lit(1)).alias("n_found"))
    return worst.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_exact")).select(
        "n_exact", n_found.scalar().alias("n_found"), (n_found.scalar() / F.col("n_exact")).alias("recall")
    )
