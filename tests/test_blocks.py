"""Blocks built by a task from the texts of a shard, and terms of lost documents."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from ranklake.functions.text import tokenize
from ranklake.operators import lexical, lexical_index
from ranklake.sources.storage import fresh_path


@pytest.mark.parametrize("kind, name", [("long", lambda i: i), ("string", "doc {}".format)])
def test_blocks_of_texts_are_those_of_their_postings(spark, monkeypatch, kind, name):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 8)
    rng = random.Random(6)
    rows = [(name(i), " ".join(rng.choices(["a", "b", "é", "zz", "\U0001f600"], k=rng.randint(0, 12)))) for i in range(90)]
    rows += [rows[4], rows[4], (name(5), "a b"), (None, "b b"), (name(200), None), (name(201), "  ")]
    dealt = lexical_index._dealt(spark.createDataFrame(rows, f"doc_id {kind}, content string"), 90, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = lexical_index._blocks_of_texts(dealt, tokenize).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counted = lexical_index._blocks_of_postings(lexical_index.counted(dealt, tokenize, "shard", "part")).collect()
    as_set = lambda blocks: {(*(b[c] for c in ("shard", "part", "term", "n", "max_tf", "min_len")), tuple(sorted(map(repr, b["docs"])))) for b in blocks}
    assert as_set(made) == as_set(counted) and len(made) == len(counted)
    keys = [(b["shard"], b["term"] is not None, (b["term"] or "").encode(), b["part"]) for b in made]
    of_shard = [[k for k in keys if k[0] == s] for s in range(3)]
    assert all(k == sorted(k) for k in of_shard)


def test_no_text_is_no_block(spark):
    empty = spark.createDataFrame([], "doc_id long, content string")
    assert lexical.build_index(empty, fresh_path(spark, "lexical")).blocks.count() == 0


def test_ranges_lost_whole_are_counted_without_their_lists(spark, monkeypatch, rows):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 4)
    texts = [(i, f"every w{i % 7} v{i % 3}") for i in range(40)]
    index = lexical.build_index(spark.createDataFrame(texts, "doc_id long, content string"), fresh_path(spark, "lexical"), shards=2)
    documents = index.documents.collect()
    whole = {d["part"] for d in documents if d["shard"] == 0}
    gone = {d["doc_id"] for d in documents if d["shard"] == 0 or d["doc_id"] % 2}
    lost = index.documents.filter(F.col("doc_id").isin(*gone))
    counts = {}
    for i, text in texts:
        for term in text.split() if i in gone else []:
            counts[term] = counts.get(term, 0) + 1
    by_term = lexical_index._lost_by_term(index, lost)
    assert whole and rows(by_term.groupBy("term").agg(F.sum("n"))) == sorted(counts.items())
    scans = [line for line in plan_of(by_term).splitlines() if "Scan parquet" in line and "term#" in line]
    assert sorted("docs#" in line for line in scans) == [False, True]
