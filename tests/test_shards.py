"""Shards of bounded size, and searches that add up a shard's postings in one task."""

import random

import numpy as np

from conftest import plan_of
from ranklake.operators import dense, lexical, lexical_index
from ranklake.operators.topk import BestPerQuery
from ranklake.sources.storage import fresh_path
from test_lexical import brute_force, run


def corpus(n, seed, words=20):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices([f"w{j}" for j in range(words)], k=rng.randint(0, 20))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, content string")


def test_shards_grow_with_the_bytes_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "SHARD_BYTES", 2000)
    docs = {i: "long " * 100 for i in range(40)}
    index = lexical.build_index(frame(spark, docs), fresh_path(spark, "lexical"))
    assert index.blocks.select("shard").distinct().count() == 10
    assert index.postings.count() == 40


def test_a_shard_is_one_task(spark):
    rows = frame(spark, corpus(200, 1))
    dealt = lexical_index._dealt(rows, 200, 7)
    shards = [{r["shard"] for r in part} for part in dealt.rdd.glom().collect()]
    assert all(len(s) <= 1 for s in shards) and len(shards) == 7


def test_large_batches_are_added_up_by_shard_and_leave_older_versions_out(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 8)
    monkeypatch.setattr(lexical, "TASK_BYTES", 400)
    docs, path = corpus(80, 2), fresh_path(spark, "lexical")
    lexical.build_index(frame(spark, docs), path, shards=2)
    changed = {i: text + " new" for i, text in corpus(20, 3).items()}
    gone = [30, 31, 32]
    index = lexical.update_index(spark, path, frame(spark, changed), frame(spark, {i: "" for i in gone}).select("doc_id"), shards=2)
    now = {i: t for i, t in (docs | changed).items() if i not in gone}
    rng = random.Random(4)
    queries = {f"q{i}": " ".join(rng.choices([*(f"w{j}" for j in range(20)), "new", "absent"], k=5)) for i in range(12)}
    assert run(spark, index, queries, 5, limit=0, first=1, open_postings=0) == {q: brute_force(now, t, 5) for q, t in queries.items()}
    hits = lexical.search(index, spark.createDataFrame(list(queries.items()), "query_id string, query string"), 5, limit=0, first=0, open_postings=0)
    assert "CoGroups" in plan_of(hits)


def test_queries_are_compared_some_at_a_time(monkeypatch):
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(dense, "CELLS", 24)
    rng = np.random.default_rng(5)
    queries, vectors = rng.integers(0, 3, (11, 3)).astype(float), rng.integers(0, 3, (50, 3)).astype(float)
    best = BestPerQuery(11, 4)
    for lo in (0, 30):
        dense._nearest(best, queries, vectors[lo : lo + 30], np.arange(lo, min(lo + 30, 50)))
    distance = ((queries[:, None] - vectors[None]) ** 2).sum(2)
    exact = [(q, d, c) for q in range(11) for d, c in sorted((distance[q, c], c) for c in range(50))[:4]]
    assert list(zip(best.query.tolist(), best.cost.tolist(), best.doc.tolist())) == exact
