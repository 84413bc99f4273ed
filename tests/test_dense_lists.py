"""Inverted lists against the exact search."""

import os
import pickle
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from ranklake.operators import dense, dense_lists
from ranklake.sources import roles
from ranklake.sources.storage import fresh_path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def frames(spark, n=600, dims=8):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, dims)) * 4
    rows = [(i, (centers[i % 12] + rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(i, rows[5][1]) for i in range(n, n + 300)] + [(10_000, None)]  # a hot list, a row without a vector
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(4)
    return vectors, vectors.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


def test_all_lists_give_the_exact_answer(spark, rows):
    vectors, queries = frames(spark)
    index = dense_lists.build_lists(vectors, fresh_path(spark, "lists"))
    want = rows(dense.search(vectors, queries, 7))
    assert rows(dense_lists.search(index, queries, 7, probes=10**6)) == want
    assert rows(dense_lists.search(index, queries, 7, probes=10**6, limit=900)) == want
    assert index.vectors.count() == 900


def test_recall_rises_with_the_lists_probed(spark):
    vectors, queries = frames(spark)
    path = fresh_path(spark, "lists")
    dense_lists.build_lists(vectors, path, n_lists=24)
    index = dense_lists.load_lists(spark, path)
    exact = dense.search(vectors, queries, 5)
    assert 1 <= index.probes <= 24
    shares = [dense_lists.recall(dense_lists.search(index, queries, 5, probes=p), exact).first()["recall"] for p in (1, 8, 24)]
    assert shares[0] <= shares[1] <= shares[2] == 1.0 and shares[1] >= 0.9


def test_folders_that_no_query_probes_are_skipped(spark):
    vectors, queries = frames(spark)
    index = dense_lists.build_lists(vectors, fresh_path(spark, "lists"), n_lists=30)
    found = dense_lists.search(index, queries.limit(1), 3, probes=2)
    assert found.count() == 3
    assert "PartitionFilters: [isnotnull(list" in plan_of(found) or "list#" in plan_of(found).split("PartitionFilters")[1][:80]


def test_small_tables(spark):
    vectors, queries = frames(spark)
    one = dense_lists.build_lists(vectors.limit(1), fresh_path(spark, "lists"))
    assert dense_lists.search(one, queries, 3).filter("rank = 1").count() == queries.filter("embedding is not null").count()
    assert dense_lists.search(one, queries.limit(0), 3).count() == 0
    none = dense_lists.build_lists(vectors.limit(0), fresh_path(spark, "lists"))
    assert dense_lists.search(none, queries.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>")
    with pytest.raises(Exception, match="vector 1 has 1 numbers"):
        dense_lists.search(dense_lists.build_lists(vectors, fresh_path(spark, "lists")), odd.withColumnRenamed("doc_id", "query_id"), 3).count()


def test_lists_of_a_query_take_no_more_memory_than_their_number():
    rng = np.random.default_rng(6)
    rows, centroids = rng.normal(size=(5000, 4)), rng.normal(size=(400, 4))
    exact = np.argsort(dense_lists._distances(rows, centroids), axis=1, kind="stable")
    for n in (1, 3):
        tracemalloc.start()
        found = dense_lists._in_order(rows, centroids, n)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (found == exact[:, :n]).all() and peak < 5000 * 400 * 8
    nan = np.array([[np.nan, np.inf, np.nan], [np.nan, 2.0, 2.0], [np.nan] * 3])
    assert dense_lists._least(nan, 1).tolist() == np.argsort(nan, axis=1, kind="stable")[:, :1].tolist()


def test_queries_that_probe_all_lists_are_sent_once():
    rng = np.random.default_rng(6)
    queries, centroids = rng.normal(size=(1000, 4)), rng.normal(size=(200, 4))
    every = dense_lists._by_list(queries, centroids, 200)
    assert len(pickle.dumps(every)) < 20_000 and all((own == np.arange(1000)).all() for own in every.values()) and len(every) == 200
    probed = dense_lists._in_order(queries, centroids, 7)
    assert {c: own.tolist() for c, own in dense_lists._by_list(queries, centroids, 7).items()} == {
        c: np.flatnonzero((probed == c).any(1)).tolist() for c in np.unique(probed).tolist()
    }


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_recall_on_the_tables(spark):
    vectors = roles.vectors(spark, SF_DIR)
    queries = vectors.filter(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    index = dense_lists.build_lists(vectors, fresh_path(spark, "lists"))
    measured = dense_lists.recall(dense_lists.search(index, queries, 10), dense.search(vectors, queries, 10)).first()
    assert measured["n_exact"] == 10 * queries.count() and measured["recall"] >= 0.9
