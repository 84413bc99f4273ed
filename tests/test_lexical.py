import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from ranklake.operators import lexical, lexical_index
from ranklake.sources.snapshots import SnapshotStore
from ranklake.sources.storage import fresh_path


def brute_force(docs, query, k):
    """BM25 by the formula, documents without any query term left out."""
    tokens = {d: t.split() for d, t in docs.items()}
    n = len(docs)
    avg_len = sum(map(len, tokens.values())) / n
    df = Counter(w for t in tokens.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if r < 0 else r for w, r in raw.items()}
    scores = {}
    for doc, words in tokens.items():
        tf = Counter(words)
        hit = [w for w in query.split() if w in tf]
        if hit:
            scores[doc] = round(sum(
                idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / avg_len))
                for w in hit), 6)
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return [(doc, i, float(k - i + 1), score) for i, (doc, score) in enumerate(ranked, 1)]


def make(spark, docs, **options):
    kind = "long" if isinstance(next(iter(docs)), int) else "string"
    passages = spark.createDataFrame(list(docs.items()), f"doc_id {kind}, content string")
    return passages, lexical.build_index(passages, fresh_path(spark, "lexical"), **options)


def run(spark, index, queries, k, **options):
    frame = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    out = {q: [] for q in queries}
    for r in lexical.search(index, frame, k, **options).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["doc_id"], r["rank"], r["score"], r["bm25_score"]))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = {i: " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(0, 25)))
            for i in range(120)}
    docs[120] = docs[7]  # a copy: equal scores
    queries = {f"q{i}": " ".join(rng.choices(words + ["absent"], k=rng.randint(1, 8)))
               for i in range(15)}
    queries["nothing"] = "absent ABSENT"
    queries["blank"] = "  "
    return docs, queries


@pytest.mark.parametrize("limit, first, ranges, opened", [(1 << 26, 2, 128, 0), (0, 1, 4, 0), (1 << 26, 0, 1, 0), (0, 2, 8, 1 << 40)])
@pytest.mark.parametrize("ids", [int, "doc {:03d}".format])
def test_search_matches_brute_force(spark, corpus, monkeypatch, limit, first, ranges, opened, ids):
    docs, queries = corpus
    docs = {ids(d): text for d, text in docs.items()}
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", ranges)
    _, index = make(spark, docs, shards=3)
    found = run(spark, index, queries, 10, limit=limit, first=first, open_postings=opened)
    assert found == {q: brute_force(docs, t, 10) for q, t in queries.items()}


def test_hits_do_not_depend_on_the_batch(spark, corpus):
    docs, queries = corpus
    _, index = make(spark, docs)
    whole = run(spark, index, queries, 5)
    assert run(spark, index, queries, 5, open_postings=0) == whole
    for q, opened in (("q3", 0), ("q8", 1 << 40)):
        assert run(spark, index, {q: queries[q]}, 5, open_postings=opened)[q] == whole[q]
    # The first five are a prefix of the first six.
    longer = run(spark, index, queries, 6)
    assert all([h[0] for h in whole[q]] == [h[0] for h in longer[q]][:5] for q in queries)


def test_keys_may_be_null(spark, corpus):
    docs, queries = corpus
    _, index = make(spark, docs)
    frame = spark.createDataFrame([(None, 1, queries["q3"]), ("a", 2, queries["q3"])], "query_id string, variant_no int, query string")
    rows = lexical.search(index, frame, 5, keys=["query_id", "variant_no"]).collect()
    assert len(rows) == 10 and [r["doc_id"] for r in rows if r["query_id"] is None] == [r["doc_id"] for r in rows if r["query_id"]]


def test_negative_idf_repeated_terms_case_and_empty_document(spark):
    docs = {"a": "all red", "b": "all blue blue", "c": "all Red", "d": ""}
    _, index = make(spark, docs)
    assert index.n_docs == 4 and index.avg_len == 7 / 4
    queries = {"all": "all", "twice": "red red", "once": "red", "unknown": "green"}
    got = run(spark, index, queries, 4)
    assert got == {q: brute_force(docs, t, 4) for q, t in queries.items()}
    assert [h[0] for h in got["once"]] == ["a"]
    assert got["twice"][0][3] == pytest.approx(2 * got["once"][0][3], abs=2e-6)
    idf = {r["term"]: r["idf"] for r in lexical.term_stats(index).collect()}
    assert idf["all"] == pytest.approx(index.idf_floor) and idf["all"] > 0


def test_padding_to_k(spark):
    docs = {i: "x" if i in (0, 2, 5) else "y" for i in range(8)}
    passages, index = make(spark, docs)
    queries = spark.createDataFrame([("x", "x"), ("none", "zzz")], "query_id string, query string")
    hits = lexical.pad_hits(lexical.search(index, queries, 5), queries, passages, 5)
    got = {}
    for r in hits.orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["rank"], r["score"]))
    assert got["x"] == [(0, 1, 5.0), (2, 2, 4.0), (5, 3, 3.0), (1, 4, 2.0), (3, 5, 1.0)]
    assert [d for d, _, _ in got["none"]] == [0, 1, 2, 3, 4]


def test_index_opened_again(spark, corpus, rows):
    docs, queries = corpus
    passages = spark.createDataFrame(list(docs.items()), "doc_id long, content string")
    path = fresh_path(spark, "lexical")
    built = lexical.build_index(passages, path)
    again = lexical.load_index(spark, path)
    assert rows(built.postings) == rows(again.postings)
    assert run(spark, again, queries, 3) == run(spark, built, queries, 3)
    lengths = {r["doc_id"]: r["doc_len"] for r in lexical.doc_lengths(passages).collect()}
    assert lengths == {d: len(t.split()) for d, t in docs.items()}


def test_ranges_below_the_threshold_stay_closed(spark, monkeypatch):
    # One document a range: ten good documents settle the threshold, and hundreds of weak ones are never opened.
    docs = {i: "rare rare common" if i < 10 else "common " + "filler " * 40 for i in range(400)}
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 1)
    _, index = make(spark, docs, shards=2)
    opened, scores = [], lexical._scores

    def counted(index, weights, ranges, limit):
        opened.append(ranges.count())
        return scores(index, weights, ranges, limit)

    monkeypatch.setattr(lexical, "_scores", counted)
    found = run(spark, index, {"q": "rare common"}, 5, first=10, open_postings=0)["q"]
    assert found == brute_force(docs, "rare common", 5)
    assert sum(opened) < 40


def test_nothing_goes_through_the_driver_and_postings_stay_where_they_are(spark, corpus):
    docs, queries = corpus
    _, index = make(spark, docs, shards=4)
    frame = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    hits = lexical.search(index, frame, 5, open_postings=0)
    hits.collect()
    plan = plan_of(hits).split("Initial Plan")[0]
    assert "WindowGroupLimit" in plan and "Python" not in plan and "Arrow" not in plan
    assert "SubqueryBroadcast dynamicpruning" in plan
    assert not spark.catalog.listTables()


# -- segments ----------------------------------------------------------------


def contents(index):
    """All that a rebuild has too."""
    sets = [sorted(map(tuple, df.collect())) for df in (index.postings, index.terms, index.documents.select("doc_id", "copies", "doc_len"))]
    return sets, index.n_docs, index.avg_len


def test_deliveries_equal_a_rebuild(spark, corpus):
    docs, queries = corpus
    rng = random.Random(8)
    path, now = fresh_path(spark, "lexical"), dict(docs)
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, content string")
    lexical.build_index(frame(docs), path, shards=2)
    segments = []
    for step in range(9):
        changed = {rng.randrange(140): " ".join(rng.choices(["w1", "w2", "new", f"only{step}"], k=rng.randint(0, 9))) for _ in range(6)}
        gone = [d for d in rng.sample(sorted(now), 3) if d not in changed] + [999]
        ids = spark.createDataFrame([(d,) for d in gone], "doc_id long")
        index = lexical.update_index(spark, path, frame(changed) if step != 4 else None, ids if step != 2 else None, batch=("s", step))
        if step != 4:
            now |= changed
        if step != 2:
            for d in gone:
                now.pop(d, None)
        segments.append(len(lexical_index._segments(path, SnapshotStore(path).manifest(spark))))
        if step in (1, 4, 8):
            rebuilt = lexical.build_index(frame(now), fresh_path(spark, "lexical"))
            assert contents(index) == contents(rebuilt)
            assert index.idf_floor == pytest.approx(rebuilt.idf_floor, abs=1e-12)
            assert run(spark, index, queries, 10) == {q: brute_force(now, t, 10) for q, t in queries.items()}
    assert segments[0] == 2 and max(segments) <= 8 and any(b < a for a, b in zip(segments, segments[1:]))
    before = contents(index)
    assert contents(lexical.update_index(spark, path, frame({1: "again"}), batch=("s", 8))) == before


def test_an_index_that_loses_all_documents(spark):
    path = fresh_path(spark, "lexical")
    passages = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, content string")
    lexical.build_index(passages, path)
    index = lexical.update_index(spark, path, deleted=passages)
    assert (index.n_docs, index.avg_len, index.terms.count(), index.postings.count()) == (0, 0.0, 0, 0)
    assert run(spark, index, {"q": "x"}, 3) == {"q": []}
    index = lexical.update_index(spark, path, passages)
    assert run(spark, index, {"q": "x"}, 3)["q"][0][0] == "a"


def test_tokenizer_plug_in(spark):
    lowered = lambda c: lexical.tokenize(F.lower(c))
    docs = {1: "Red", 2: "blue"}
    _, index = make(spark, docs, tokenizer=lowered)
    assert [h[0] for h in run(spark, index, {"q": "RED"}, 3, tokenizer=lowered)["q"]] == [1]
