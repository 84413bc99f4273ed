import numpy as np
import pytest

from conftest import plan_of
from ranklake.operators import dense


def frames(spark, vectors, queries, id_kind="long"):
    return (
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()],
                              f"doc_id {id_kind}, embedding array<float>").repartition(3),
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries.items()],
                              "query_id long, embedding array<float>"),
    )


def brute_force(vectors, queries, k):
    out = []
    for q, u in queries.items():
        scored = sorted(
            (round(float(((np.float32(u).astype(float) - np.float32(v).astype(float)) ** 2).sum()), 6), i)
            for i, v in vectors.items())
        out += [(q, i, rank, d) for rank, (d, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def hits(df):
    return sorted((r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("limit", [dense.BROADCAST_BYTES, 2000])
def test_both_ways_match_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8) for i in range(200)}
    for i in range(200, 280):  # copies: equal distances
        vectors[i] = vectors[5]
    queries = {i: rng.normal(size=8) for i in range(25)}
    queries[25] = vectors[5]
    v, q = frames(spark, vectors, queries)
    assert hits(dense.search(v, q, 7, limit=limit)) == brute_force(vectors, queries, 7)


def test_text_ids_ties_and_small_corpus(spark):
    vectors = {"b": [1, 0], "a": [-1, 0], "c": [3, 0]}
    v, q = frames(spark, vectors, {1: [0, 0]}, "string")
    assert hits(dense.search(v, q, 5)) == [(1, "a", 1, 1.0), (1, "b", 2, 1.0), (1, "c", 3, 9.0)]


def test_no_queries_and_k_zero(spark):
    v, q = frames(spark, {1: [0, 1]}, {1: [0, 1]})
    assert dense.search(v, q.filter("query_id > 5"), 3).count() == 0
    assert dense.search(v, q, 0).count() == 0
    assert hits(dense.search(v, q, 3)) == [(1, 1, 1, 0.0)]


def test_batches_within_a_task(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=4) for i in range(500)}
    queries = {i: rng.normal(size=4) for i in range(3)}
    v, q = frames(spark, vectors, queries)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert hits(dense.search(v.coalesce(2), q, 9)) == brute_force(vectors, queries, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_cross_join(spark):
    v, q = frames(spark, {1: [0, 1]}, {1: [0, 1]})
    for limit in (dense.BROADCAST_BYTES, 1):
        plan = plan_of(dense.search(v, q, 3, limit=limit))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
