"""Vectors are picked by a product of single precision where that leaves few pairs, and exact in any case."""

import numpy as np
import pytest

from ranklake.operators import dense
from ranklake.operators.topk import BestPerQuery


def nearest(queries, vectors, k):
    best = BestPerQuery(len(queries), k)
    for lo in range(0, len(vectors), 700):
        dense._nearest(best, queries, vectors[lo : lo + 700], np.arange(lo, min(lo + 700, len(vectors))))
    return list(zip(best.query.tolist(), best.cost.tolist(), best.doc.tolist()))


def brute_force(queries, vectors, k):
    distance = np.round(((queries[:, None] - vectors[None]) ** 2).sum(2), dense.SCORE_DIGITS)
    return [(q, d, c) for q in range(len(queries)) for d, c in sorted((distance[q, c], c) for c in range(len(vectors)))[:k]]


def test_unit_vectors_need_single_precision_only(monkeypatch):
    monkeypatch.setattr(dense, "CELLS", 5000)
    monkeypatch.setattr(dense, "_picked_double", None)
    rng = np.random.default_rng(1)
    queries, vectors = (rows / np.linalg.norm(rows, axis=1, keepdims=True) for rows in (rng.normal(size=(30, 16)), rng.normal(size=(2000, 16))))
    vectors[900:940] = vectors[7]
    assert nearest(queries, vectors, 6) == brute_force(queries, vectors, 6)


@pytest.mark.parametrize("shift, factor", [(1e5, 1), (0, 1e20), (0, 1e-20), (3, 0)])
def test_large_small_and_equal_vectors_are_exact(monkeypatch, shift, factor):
    monkeypatch.setattr(dense, "CELLS", 5000)
    rng = np.random.default_rng(2)
    queries, vectors = rng.normal(size=(12, 4)) * factor + shift, rng.normal(size=(1500, 4)) * factor + shift
    assert nearest(queries, vectors, 5) == brute_force(queries, vectors, 5)


def test_blocks_give_each_core_several_pairs(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 10)
    rows = spark.range(400).selectExpr("id AS doc_id", "array(float(id), float(1)) AS embedding")
    found = dense.search(rows, rows.withColumnRenamed("doc_id", "query_id"), 1, limit=20_000)
    assert found.filter("doc_id = query_id AND score = 0").count() == 400
    assert "sequence(0, 7," in found._jdf.queryExecution().analyzed().toString()
