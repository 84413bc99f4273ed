"""Large batches of queries: the best are kept by task, and nothing grows with queries times ranges or shards."""

import random

import pyarrow as pa
import pytest

from ranklake.operators import lexical, lexical_index
from ranklake.sources.storage import fresh_path
from test_lexical import brute_force, run
from test_shards import corpus, frame


@pytest.mark.parametrize("limit, share", [(1 << 26, 1 / 600), (2000, 2.0)])
def test_a_large_batch_finds_the_same_without_ranges(spark, monkeypatch, limit, share):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 8)
    monkeypatch.setattr(lexical, "DENSE_SHARE", share)
    made = []
    monkeypatch.setattr(lexical, "_bounds", lambda *a: made.append(a))
    docs, path = corpus(80, 2), fresh_path(spark, "lexical")
    lexical.build_index(frame(spark, docs), path, shards=3)
    changed = {i: text + " new" for i, text in corpus(20, 3).items()}
    index = lexical.update_index(spark, path, frame(spark, changed), frame(spark, {30: "", 31: ""}).select("doc_id"), shards=2)
    now = {i: t for i, t in (docs | changed).items() if i not in (30, 31)}
    rng = random.Random(4)
    queries = {f"q{i}": " ".join(rng.choices([*(f"w{j}" for j in range(20)), "new", "absent"], k=5)) for i in range(30)}
    assert run(spark, index, queries, 5, limit=limit, open_postings=0, few_queries=0) == {q: brute_force(now, t, 5) for q, t in queries.items()}
    assert not made


def shard(docs, ids=pa.int64()):
    postings = {}
    for d, text in docs:
        for w in set(text.split()):
            postings.setdefault(w, []).append((d, text.split().count(w), len(text.split())))
    columns = [pa.array([[p[i] for p in rows] for rows in postings.values()], pa.list_(t)) for i, t in enumerate((ids, pa.int64(), pa.int64()))]
    numbers = pa.array([0] * len(postings), pa.int32())
    return pa.RecordBatch.from_arrays([numbers, numbers, pa.array(postings), *columns], ["seg", "shard", "term", "doc_id", "tf", "doc_len"])


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_scores_of_a_shard_are_exact_with_ties_repeated_and_null_ids_and_weights_below_zero(sign):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "a b"), (70, texts[5]), (None, "a c c")]
    terms = [sorted(set(rng.choices("abcdefghz", k=4))) for _ in range(40)]
    weights = [[sign * rng.choice([0.5, 1.25, 2.0]) for _ in t] for t in terms]
    queries = lexical._query_terms(pa.table({"q": range(40), "scale": [1e12] * 40, "terms": terms, "weights": weights}))
    got = {}
    for batch in lexical._best_of_shards(iter([shard(docs)]), queries, 7, 5.0):
        for row in batch.to_pylist():
            got.setdefault(row["q"], []).append((-row["bm25_score"], -1 if row["doc_id"] is None else row["doc_id"]))
    for q, (names, of) in enumerate(zip(terms, weights)):
        sums = {}
        for d, text in docs:
            words = text.split()
            for name, weight in zip(names, of):
                if tf := words.count(name):
                    d_ = -1 if d is None else d
                    sums[d_] = sums.get(d_, 0) + round(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / 5.0)) * 1e12)
        assert sorted(got.get(q, [])) == sorted((-round(s / 1e12, 6), d) for d, s in sums.items())[:7]
