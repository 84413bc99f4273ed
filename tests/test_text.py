import pytest
from pyspark.sql import functions as F

from ranklake.functions import text

SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0",
          " ", " ", " ", " ", " ", " ", " ", "　"]
SAMPLES = ["", " ", "a", " a b ", "a​b", "".join(SPACES), "x" + "".join(SPACES) + "y",
           "tail\n", "\n\nhead", "É  é"] + [f"{s}a{s}b{s}" for s in SPACES]


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_strip_and_tokenize_match_python(spark):
    assert apply(spark, text.strip, SAMPLES) == [s.strip() for s in SAMPLES]
    assert apply(spark, text.tokenize, SAMPLES) == [s.split() for s in SAMPLES]


def test_tokenize_null(spark):
    assert apply(spark, text.tokenize, [None]) == [[]]


@pytest.mark.parametrize("length", [200, 500])
def test_snippet_marks_a_cut_only(spark, length):
    whole, longer = "x" * length, "x" * (length + 1)
    assert apply(spark, lambda c: text.snippet(c, length), [whole, longer, ""]) == [
        whole, "x" * length + "…", ""]


def test_stars_round_half_to_even(spark):
    assert apply(spark, text.star_bar, [4.5, 3.5, 0.0, 5.0, None, float("nan")], "double") == [
        "★★★★☆", "★★★★☆", "☆☆☆☆☆", "★★★★★", "", ""]


def test_rating_and_count_notes(spark):
    assert apply(spark, text.rating_note, [4.3, None, float("nan")], "double") == [
        " (rated 4.3/5)", "", ""]
    assert apply(spark, text.review_count_note, [1234, 0, None, 7], "long") == [
        "(1,234 reviews)", "", "", "(7 reviews)"]


def test_search_mode(spark):
    labels = [" Semantic ", "BM25", "hybrid", "other", ""]
    assert apply(spark, text.search_mode, labels) == [
        "semantic", "bm25", "hybrid", "hybrid", "hybrid"]


def test_joined_lists(spark):
    lists = [None, [], ["a", None], ["", ""], ["a", "b"]]
    assert apply(spark, lambda c: text.joined(c, "none"), lists, "array<string>") == [
        "none", "none", "a", " ", "a b"]
