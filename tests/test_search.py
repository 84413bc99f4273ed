import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklake.functions.models import hashing_embedder, token_overlap_scorer
from ranklake.operators import dense, evaluate, lexical, passages, present
from ranklake.operators.fusion import as_list, rrf_fuse
from ranklake.operators.rerank import rerank
from ranklake.plans import search as plans
from ranklake.sources import querysets
from ranklake.sources.storage import fresh_path

TEXTS = ["red wireless controller", "blue wired controller", "headset with clear voice",
         "game of war", "family game for the television", "red cable", "console and controller",
         "voice chat headset red", "war", "wireless headset", "cable cable cable", "blue game"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(
        [(f"d{i:02d}", t, f"Title {i}") for i, t in enumerate(TEXTS)],
        "doc_id string, content string, product_title string")
    embed = hashing_embedder(32)
    vectors = plans.embed_passages(docs, embed).select("doc_id", "embedding")
    return plans.Corpus(docs, lexical.build_index(docs, fresh_path(spark, "lex")), vectors, embed)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [(1, "red controller"), (2, " war game "), (3, "   "), (4, "absent")], "query_id int, query string")


def listed(hits, query_id):
    rows = hits.filter(F.col("query_id") == query_id).orderBy("rank").collect()
    return [(r["doc_id"], r["rank"], r["score"]) for r in rows]


def channel_lists(corpus, spark, text, k):
    one = spark.createDataFrame([(0, text)], "query_id int, query string")
    by_words = listed(lexical.search(corpus.lexical, one, k), 0)
    embedded = plans.embed_passages(one.withColumnRenamed("query", "content"), corpus.embed)
    return listed(dense.search(corpus.vectors, embedded, k), 0), by_words


def fuse(lists):
    scores, first = {}, {}
    for list_no, items in enumerate(lists):
        for rank, doc in enumerate(items, 1):
            scores[doc] = scores.get(doc, 0) + 1 / (60 + rank)
            first.setdefault(doc, (list_no, rank))
    return sorted(scores, key=lambda d: (-round(scores[d], 12), first[d])), scores


def test_single_channel_keeps_its_own_score(spark, corpus, queries):
    nearest, by_words = channel_lists(corpus, spark, "red controller", 3)
    assert listed(plans.search(corpus, queries, "semantic", 3).hits, 1) == nearest
    # The positional score counts down from top_k, not from the pool.
    assert listed(plans.search(corpus, queries, "bm25", 3).hits, 1) == by_words
    assert [s for _, _, s in by_words] == [3.0, 2.0, 1.0]


def test_hybrid_single_wording(spark, corpus, queries):
    found = plans.search(corpus, queries, "hybrid", 4)
    for query_id, text in ((1, "red controller"), (2, "war game"), (4, "absent")):
        nearest, by_words = channel_lists(corpus, spark, text, 8)
        order, scores = fuse([[d for d, _, _ in nearest], [d for d, _, _ in by_words]])
        got = listed(found.hits, query_id)
        assert [d for d, _, _ in got] == order[:4]
        assert [s for _, _, s in got] == pytest.approx([scores[d] for d in order[:4]])
    assert found.hits.filter("query_id = 3").count() == 0
    assert found.warnings.count() == 0


def test_hybrid_fuses_complete_lists_across_wordings(spark, corpus):
    wordings = ["red controller", "wireless headset", "cable"]
    frame = spark.createDataFrame([(9, i, t) for i, t in enumerate(wordings)],
                                  "query_id int, variant_no int, query string")
    per_wording = []
    for text in wordings:
        nearest, by_words = channel_lists(corpus, spark, text, 8)
        per_wording.append(fuse([[d for d, _, _ in nearest], [d for d, _, _ in by_words]])[0])
    order, scores = fuse(per_wording)
    got = listed(plans.search(corpus, frame, "hybrid", 4).hits, 9)
    assert [d for d, _, _ in got] == order[:4]
    assert [s for _, _, s in got] == pytest.approx([scores[d] for d in order[:4]])


@pytest.mark.parametrize("mode", ["semantic", "bm25"])
def test_single_channel_with_several_wordings(spark, corpus, mode):
    wordings = ["red controller", "voice headset"]
    frame = spark.createDataFrame(
        [(9, i, t) for i, t in enumerate(wordings)] + [(8, 0, "war")],
        "query_id int, variant_no int, query string")
    position = 0 if mode == "semantic" else 1
    lists = [[d for d, _, _ in channel_lists(corpus, spark, t, 8)[position]] for t in wordings]
    order, _ = fuse(lists)
    hits = plans.search(corpus, frame, mode, 3).hits
    assert [d for d, _, _ in listed(hits, 9)] == order[:3]
    # The other query of the batch has one wording and is not fused.
    assert listed(hits, 8) == channel_lists(corpus, spark, "war", 3)[position]


def test_missing_indexes(spark, corpus, queries, rows):
    no_words = plans.Corpus(corpus.passages, None, corpus.vectors, corpus.embed)
    hybrid = plans.search(no_words, queries, "hybrid", 3)
    assert listed(hybrid.hits, 1) == listed(plans.search(corpus, queries, "semantic", 3).hits, 1)
    assert {w for _, w in rows(hybrid.warnings)} == {plans.NO_LEXICAL}
    only_words = plans.search(no_words, queries, "bm25", 3)
    assert only_words.hits.count() == 0 and only_words.warnings.count() == 3
    no_vectors = plans.Corpus(corpus.passages, corpus.lexical)
    assert plans.search(no_vectors, queries, "bm25", 3).hits.count() > 0
    for mode in ("semantic", "hybrid"):
        found = plans.search(no_vectors, queries, mode, 3)
        assert found.hits.count() == 0
        assert {w for _, w in rows(found.warnings)} == {plans.NO_VECTORS}
    with pytest.raises(ValueError):
        plans.search(corpus, queries, "other", 3)


def test_requests_with_modes(spark, corpus):
    requests = spark.createDataFrame(
        [(1, "war", " BM25 "), (2, "war", "Semantic"), (3, "war", "what"), (4, "war", None)],
        "query_id int, query string, mode string")
    hits = plans.search_requests(corpus, requests, 3).hits
    nearest, by_words = channel_lists(corpus, spark, "war", 3)
    assert listed(hits, 1) == by_words and listed(hits, 2) == nearest
    assert listed(hits, 3) == listed(hits, 4) != nearest


def test_retrieve_with_expansion_and_reranking(spark, corpus, queries, rows):
    responses = spark.createDataFrame(
        [(1, '["wireless headset", "cable"]'), (2, "no")], "query_id int, raw_response string")
    found = plans.retrieve(corpus, queries, responses=responses, top_k=3, scorer=token_overlap_scorer())
    assert rows(found.variants.filter("query_id = 1"), "query") == [
        ("cable",), ("red controller",), ("wireless headset",)]
    frame = spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(["red controller", "wireless headset", "cable"])],
        "query_id int, variant_no int, query string")
    pool = plans.search(corpus, frame, "hybrid", 15).hits.orderBy("rank").collect()
    wanted = {"red", "controller"}
    order = sorted(pool, key=lambda r: -len(wanted & set(r["content"].split())))[:3]
    got = found.hits.filter("query_id = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in order]
    assert [r["retrieval_score"] for r in got] == [r["score"] for r in order]
    assert [r["score"] for r in got][0] == 1.0
    notes = dict(rows(found.warnings))
    assert notes[3] == "Empty query." and "using original query only" in notes[2]


def test_retrieve_without_expansion(spark, corpus, queries, rows):
    found = plans.retrieve(corpus, queries, mode="semantic", top_k=2)
    assert rows(found.variants) == [(1, 0, "red controller"), (2, 0, "war game"), (4, 0, "absent")]
    assert found.hits.groupBy("query_id").count().filter("count = 2").count() == 3
    assert rows(found.warnings) == [(3, "Empty query.")]


def test_rerank_edges(spark, rows):
    queries = spark.createDataFrame([(1, "x y")], "query_id int, query string")
    hits = spark.createDataFrame(
        [(1, "a", 1, 0.9, None), (1, "b", 2, 0.8, "x"), (1, "c", 3, 0.7, "y z"), (1, "d", 4, 0.6, "x y")],
        "query_id int, doc_id string, rank int, score double, content string")
    got = rerank(hits, queries, 3, token_overlap_scorer()).orderBy("rank").collect()
    # Equal scores keep their former order; a missing content counts as empty.
    assert [(r["doc_id"], r["score"], r["retrieval_score"]) for r in got] == [
        ("d", 1.0, 0.6), ("b", 0.5, 0.8), ("c", 0.5, 0.7)]
    assert rerank(hits, queries, 0, token_overlap_scorer()).count() == 0
    assert rerank(hits.limit(0), queries, 3, token_overlap_scorer()).count() == 0


def test_enrich(spark, rows):
    hits = spark.createDataFrame([(1, 7, "old"), (2, 8, "kept"), (3, None, "none"), (4, 9, "x")],
                                 "query_id int, doc_id long, content string")
    table = spark.createDataFrame([("7", "new"), ("9", None), ("5", "other"), ("7", "mew")],
                                  "doc_id string, content string")
    assert rows(passages.enrich(hits, table, ["content"]), "query_id", "content") == [
        (1, "new"), (2, "kept"), (3, "none"), (4, None)]
    assert rows(passages.duplicate_ids(table)) == [("7", 2)]


def test_passages(spark):
    table = spark.createDataFrame([("1", "b", "f", "x"), ("2", None, "g", "y")],
                                  "doc_id string, text_bm25 string, text_faiss string, store string")
    for_words, for_vectors = passages.build_dual_corpora(table)
    assert for_words.columns == for_vectors.columns == ["content", "doc_id", "store"]
    assert sorted(r["content"] for r in for_words.collect()) == ["", "b"]
    assert passages.to_passages(table.drop("text_faiss"), "text_bm25").count() == 2


def test_context(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "empty")], "query_id int, query string")
    hits = spark.createDataFrame(
        [(1, 2, "T2", None, "x" * 501, "r"), (1, 1, "", 4.5, "", " review "), (1, 5, "T5", float("nan"), "y" * 500, None)],
        "query_id int, rank int, product_title string, average_rating double, content string, review_texts string")
    got = {r["query_id"]: r["prompt"] for r in present.build_context(queries, hits).collect()}
    assert got[1] == (
        "User query: q\n\nTop retrieved products:\n"
        "1. Unknown product (rated 4.5/5)\nreview\n\n"
        f"2. T2\n{'x' * 500}…\n\n3. T5\n{'y' * 500}\n\n"
        "Based only on the products above, answer the user's query in 2-3 sentences.")
    assert "products:\n\n\nBased" in got[2]


def test_cards(spark):
    hits = spark.createDataFrame(
        [(1, 1, "A", "T", 4.5, 1234, "z" * 201, 0.03278), (1, 2, "B", None, None, 5, "", 1.0)],
        "query_id int, rank int, parent_asin string, product_title string, average_rating double, "
        "rating_number long, review_texts string, score double")
    first, second = present.result_cards(hits).orderBy("rank").collect()
    assert first["title"] == "T" and first["rating_line"] == "★★★★☆ 4.5 (1,234 reviews)"
    assert first["review_quote"] == '"' + "z" * 200 + '…"'
    assert first["caption"] == "Score: 0.0328 | ASIN: A"
    assert (second["title"], second["rating_line"], second["review_quote"]) == ("Unknown product", "", "")


def test_mode_comparison(spark, rows):
    def hits(data):
        return spark.createDataFrame(data, "query_id long, doc_id string, rank int")

    left = hits([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)])
    right = hits([(1, "b", 1), (1, "x", 2), (1, "a", 3)])
    overlap = evaluate.mode_overlap(left, right, 2)
    assert rows(overlap) == [(1, 2, 2, 1), (2, 1, 0, 0)]
    judged = querysets.retrieval_queries(spark)
    wins = {}
    for difficulty, winner, n in rows(evaluate.judged_wins(judged)):
        wins[winner] = wins.get(winner, 0) + n
    assert wins == {"BM25": 6, "Semantic": 4}
    assert rows(evaluate.compare_modes(overlap, judged), "query_id", "winner") == [(1, "BM25"), (2, "BM25")]
    assert querysets.answer_queries(spark).count() == 5


def test_fusion_of_searches_is_what_hybrid_does(spark, corpus, queries):
    clean = queries.filter("query_id = 1")
    embedded = plans.embed_passages(clean.withColumnRenamed("query", "content"), corpus.embed)
    lists = as_list(dense.search(corpus.vectors, embedded, 8), 0).unionByName(
        as_list(lexical.search(corpus.lexical, clean, 8).drop("bm25_score"), 1))
    assert listed(rrf_fuse(lists), 1)[:4] == listed(plans.search(corpus, clean, "hybrid", 4).hits, 1)


def test_embedder_is_a_unit_vector_per_text():
    embed = hashing_embedder(16)()
    out = embed(["a b c", "", "a", "a b c"])
    assert out.shape == (4, 16) and out.dtype == np.float32
    assert np.allclose(np.linalg.norm(out, axis=1), [1, 0, 1, 1]) and (out[0] == out[3]).all()
    assert (embed(["b"])[0] == embed(["z z", "b"])[1]).all()
