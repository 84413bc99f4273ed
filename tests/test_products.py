import hashlib
import json

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from ranklake.operators import products, reviews, sizing
from ranklake.plans.product_table import product_table, run_etl
from ranklake.sources import tables
from ranklake.sources.schemas import PRODUCT_META, PRODUCTS

REVIEW = "parent_asin string, text string, rating double, helpful_vote long"


@pytest.fixture
def raw_reviews(spark):
    many = [("P12", f"t{i:02d}", float(i % 5 + 1), i) for i in range(12)]
    return spark.createDataFrame(
        many
        + [
            ("P1", "only", 4.0, None),
            ("PT", "b", 1.0, 3),
            ("PT", "a", 2.0, 3),
            ("PT", "zero", 5.0, None),
            ("PB", None, 5.0, 9),
            ("PB", "", 5.0, 9),
            ("PB", "   ", 5.0, 9),
            ("PB", "\t", 2.0, 1),
            (None, "stray", 1.0, 1),
        ],
        REVIEW,
    )


def meta_row(asin, **values):
    row = dict(parent_asin=asin, title=f"Title {asin}", main_category="Games", average_rating=4.5,
               rating_number=10, store="Shop", price="9.99", features=["f1", "f2"],
               description=["d"], categories=["c1", "c2"], details='{"k": 1}')
    row.update(values)
    return tuple(row[name] for name in PRODUCT_META.fieldNames())


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_top_reviews(spark, raw_reviews, rows, hot_rows):
    got = rows(reviews.aggregate_reviews(raw_reviews, 10, hot_rows))
    assert got == [
        ("P1", "only", 4.0),
        # Votes 11 down to 2.
        ("P12", " ".join(f"t{i:02d}" for i in range(11, 1, -1)),
         round(sum(i % 5 + 1 for i in range(2, 12)) / 10, 2)),
        # Only spaces make a text blank.
        ("PB", "\t", 2.0),
        # Tied votes in text order; a missing vote is zero.
        ("PT", "a b zero", 2.67),
    ]


def test_salted_and_plain_ranking_agree(spark, rows):
    df = spark.createDataFrame(
        [("hot" if i % 3 else f"p{i % 7}", f"text {i * 7919 % 1000}", float(i % 5), i * 31 % 17)
         for i in range(900)], REVIEW)
    assert rows(reviews.rank_reviews(df, 10, 1_000_000)) == rows(reviews.rank_reviews(df, 10, 50))


def test_group_limit_runs_before_the_shuffle(spark, raw_reviews):
    plan = plan_of(reviews.aggregate_reviews(raw_reviews))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_keys_are_counted_where_a_hash_has_many_rows(spark, rows):
    keys = spark.range(3000).select(F.when(F.col("id") < 2000, F.concat(F.lit("k"), F.col("id"))).when(F.col("id") < 2900, "hot").alias("k"))
    assert rows(sizing.hot_keys(keys, "k", 300)) == [("hot", 3)]
    assert rows(sizing.hot_keys(keys, "k", 90)) == [("hot", 10), (None, 2)]
    none = sizing.hot_keys(keys, "k", 1000)
    assert none.collect() == []
    assert "Aggregate(keys=[k#" not in plan_of(none).split("Initial Plan")[0]


def test_clean_meta(spark):
    meta = spark.createDataFrame(
        [
            meta_row("A", price=None, features=None, description=None, categories=None),
            meta_row("B", price="", features=[], description=[]),
            meta_row("C", price=" 9.5 ", features=["a", None], description=["x", "y"]),
        ],
        PRODUCT_META,
    )
    got = {r["parent_asin"]: r for r in products.clean_meta(meta).collect()}
    assert [got[k]["price"] for k in "ABC"] == ["unknown", "unknown", "9.5"]
    assert [got[k]["features"] for k in "ABC"] == ["no features listed", "no features listed", "a"]
    assert [got[k]["description"] for k in "ABC"] == ["", "", "x y"]
    assert [got[k]["categories"] for k in "ABC"] == ["", "c1 c2", "c1 c2"]


def test_product_table(spark, raw_reviews):
    meta = spark.createDataFrame(
        [
            meta_row("PT"),
            meta_row("NONE", description=None, store=None, average_rating=None),
            meta_row("NT", title=None),
            meta_row("PT", title="Second"),
        ],
        PRODUCT_META,
    )
    table = product_table(raw_reviews, meta)
    assert table.columns == PRODUCTS.fieldNames()
    got = {(r["parent_asin"], r["product_title"]): r for r in table.collect()}
    first = got["PT", "Title PT"]
    assert first["doc_id"] == hashlib.md5(b"PT").hexdigest() == got["PT", "Second"]["doc_id"]
    assert first["text_bm25"] == (
        "Product ID: PT\nCategory: Games\nSeller: Shop\nCategories: c1 c2\n"
        "Product title: Title PT\nFeatures: f1 f2\nDescription: d\nAverage rating: 4.5\n"
        "Number of ratings: 10\nPrice: 9.99\nCustomer reviews: a b zero\n")
    assert first["text_faiss"] == (
        "Product: Title PT. Sold by Shop. Categories: c1 c2. Description: d Features: f1 f2. "
        "Rating: 4.5 from 10 ratings. Price: 9.99. Customer reviews: a b zero")
    bare = got["NONE", "Title NONE"]
    assert bare["review_texts"] == "" and bare["avg_review_rating"] is None
    assert bare["text_faiss"] == (
        "Product: Title NONE. Sold by . Categories: c1 c2. Features: f1 f2. "
        "Rating:  from 10 ratings. Price: 9.99. Customer reviews: ")
    untitled = got["NT", None]
    assert untitled["text_bm25"] is None and untitled["text_faiss"] is None


def test_run_etl_from_json_lines(spark, tmp_path):
    (tmp_path / "reviews.jsonl").write_text("\n".join(json.dumps(r) for r in [
        {"parent_asin": "A", "text": "good", "rating": 5, "helpful_vote": 2, "images": [{"u": 1}]},
        {"parent_asin": "A", "text": "bad", "rating": 1.0, "verified_purchase": True},
    ]))
    (tmp_path / "meta.jsonl").write_text("\n".join(json.dumps(r) for r in [
        {"parent_asin": "A", "title": "x", "price": "19.99", "details": {"Brand": "b", "n": [1]}},
        {"parent_asin": "B", "title": "y", "price": 12.5, "categories": ["c"]},
    ]))
    out = str(tmp_path / "deep" / "er" / "products")
    for _ in range(2):  # a second run replaces the table
        counts = run_etl(spark, str(tmp_path / "reviews.jsonl"), str(tmp_path / "meta.jsonl"), out)
        assert (counts.reviews, counts.meta, counts.products) == (2, 2, 2)
    got = {r["parent_asin"]: r for r in tables.read_products(spark, out).collect()}
    assert got["A"]["price"] == "19.99" and got["B"]["price"] == "12.5"
    assert json.loads(got["A"]["details"]) == {"Brand": "b", "n": [1]}
    assert got["A"]["review_texts"] == "good bad" and got["A"]["avg_review_rating"] == 3.0
    narrow = tables.read_products(spark, out, "text_bm25")
    assert narrow.columns[0] == "text_bm25" and len(narrow.columns) == 7


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"parent_asin": "A"}\n{"parent_asin": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_reviews(spark, str(tmp_path / "bad.jsonl")).collect()


def test_missing_input_names_the_step(spark, tmp_path):
    with pytest.raises(tables.MissingInputError, match="build the product table first"):
        tables.read_products(spark, str(tmp_path / "nothing"))


def test_inferred_scan(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "d"}}\n{"a": 2}\n')
    df = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert df.columns == ["a", "b"] and df.count() == 2


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_all_reviews_join(spark, raw_reviews, hot_rows):
    meta = spark.createDataFrame([("P12", "x"), ("PT", "y"), ("NONE", "z"), ("PT", "y2")], "parent_asin string, title string")
    joined = products.join_all_reviews(meta, raw_reviews, hot_rows)
    got = {(r["parent_asin"], r["title"]): r["n"] for r in
           joined.groupBy("parent_asin", "title").agg(F.count("text").alias("n")).collect()}
    assert got == {("P12", "x"): 12, ("PT", "y"): 3, ("PT", "y2"): 3, ("NONE", "z"): 0}
    assert joined.count() == 19
