"""Embeddings by content, and JSON files that disagree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklake.functions.models import hashing_embedder
from ranklake.operators.embedding_cache import EmbeddingCache
from ranklake.plans.search import embed_passages
from ranklake.sources import drift
from ranklake.sources.tables import MissingInputError


def vectors(df):
    return {r["doc_id"]: np.array(r["embedding"]) for r in df.collect()}


def test_only_new_texts_go_to_the_model(spark, tmp_path):
    texts = [(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    cache = EmbeddingCache(f"{tmp_path}/cache", "hash")
    first, n = cache.embed(docs, hashing_embedder(8))
    assert n == 3  # "a b", "c" and the empty text
    want = vectors(embed_passages(docs, hashing_embedder(8)))
    again, none = cache.embed(docs, hashing_embedder(8))
    assert none == 0 and again.columns == ["doc_id", "content", "embedding"]
    for got in (vectors(first), vectors(again)):
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    more = docs.unionByName(spark.createDataFrame([(6, "new"), (7, "c")], docs.schema))
    assert cache.embed(more, hashing_embedder(8))[1] == 1
    # Another model has vectors of its own, in the same table.
    other, n = EmbeddingCache(f"{tmp_path}/cache", "other").embed(docs, hashing_embedder(4))
    assert n == 3 and {len(v) for v in vectors(other).values()} == {4}
    # What two builds wrote at a time counts once.
    cache.stored(spark).write.parquet(f"{tmp_path}/cache/twice")
    assert cache.embed(docs, hashing_embedder(8))[0].count() == 5
    assert cache.embed(docs.limit(0), hashing_embedder(8))[0].count() == 0


def test_files_that_disagree(spark, tmp_path):
    files = {
        "a": ['{"id": 1, "price": 12, "tags": ["x"], "same": true, "gone": null}', "", '{"id": 2, "price": null}'],
        "b": ['{"id": 3, "price": 1.5, "tags": ["y", "z"], "same": false}', '{"id": 4.5}'],
        "c": ['{"id": 5, "price": "free", "more": {"k": 1}}', '{"id": 6, "price": {"amount": 2}, "same": "no"}'],
    }
    for name, lines in files.items():
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
    types = drift.key_types(spark, str(tmp_path))
    by_file = {(r["file"].rsplit("/", 1)[1], r["key"], r["type"]): r["n"] for r in types.collect()}
    assert by_file[("a.json", "price", "long")] == 1 and by_file[("b.json", "id", "double")] == 1 and ("a.json", "gone", "null") not in by_file
    report = {r["key"]: (r["types"], r["merged"], r["n_values"]) for r in drift.conflicts(types).collect()}
    assert report == {"id": ("double, long", "double", 6), "price": ("double, long, object, string", "string", 4), "same": ("boolean, string", "string", 3)}
    rows = {r["id"]: r for r in drift.read_merged(spark, str(tmp_path)).collect()}
    assert rows.keys() == {1.0, 2.0, 3.0, 4.5, 5.0, 6.0}
    assert [rows[i]["price"] for i in (1.0, 2.0, 3.0, 5.0, 6.0)] == ["12", None, "1.5", "free", '{"amount": 2}']
    assert rows[3.0]["tags"] == ["y", "z"] and rows[5.0]["more"]["k"] == 1 and rows[6.0]["same"] == "no"
    with pytest.raises(MissingInputError):
        drift.key_types(spark, str(tmp_path / "nowhere"))


def test_keys_are_counted_before_a_shuffle(spark, tmp_path):
    spark.range(200).select((F.col("id") % 2).alias("x")).write.json(f"{tmp_path}/n")
    [row] = drift.key_types(spark, f"{tmp_path}/n").groupBy("key", "type").agg(F.sum("n").alias("n")).collect()
    assert tuple(row) == ("x", "long", 200)
