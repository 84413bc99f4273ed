"""Cases off the test tables: repeated checkpoints, new products, NaN, ties, duplicates, many turns."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from ranklake.functions.text import rating_note, utc_iso
from ranklake.operators import dense, expansion, profile
from ranklake.sources import roles, storage

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_later_turns_are_variants(spark, tmp_path):
    rows = [(1, i, "user", f"turn {i}") for i in range(15)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    queries, responses = roles.conversation_queries(spark, str(tmp_path))
    assert expansion.expand(queries, responses, 20)[0].count() == 15


def test_one_of_several_responses_counts(spark):
    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    responses = spark.createDataFrame([(1, '["b"]'), (1, 'so: ```json\n["a"]\n```')], "query_id long, raw_response string")
    rows = expansion.expand(queries, responses)[0].orderBy("variant_no").collect()
    assert [r["query"] for r in rows] == ["q", "b"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    row = profile.describe(df, ["x"]).first()
    assert (row["n"], row["mean"], row["max"], row["q50"]) == (2, 1.5, 2.0, 1.5)
    assert profile.null_shares(df).first()["null_share"] == 0.5
    assert profile.column_means(df, ["x"]).first()["mean"] == 1.5


def test_ratings_round_half_to_even(spark):
    df = spark.createDataFrame([(4.25,), (4.35,), (4.0,), (None,)], "r double")
    assert [r[0] for r in df.select(rating_note(F.col("r"))).collect()] == [" (rated 4.2/5)", " (rated 4.4/5)", " (rated 4.0/5)", ""]


def test_utc_whatever_the_session_time_zone(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=datetime.timezone.utc)
    df = spark.createDataFrame([(at,)], "t timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(utc_iso(F.col("t"))).first()[0] == "2024-01-02T03:04:05.000000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_discarded_tables_are_deleted(spark):
    table = storage.stored(spark.range(3).toDF("x"), "numbers")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert table.count() == 3 and os.path.isdir(folder)
    storage.discard(table, spark.range(1), table)
    storage.discard(table)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("limit", [1 << 26, 1])
def test_vectors_of_large_norm_and_of_odd_length(spark, limit):
    queries = spark.createDataFrame([(1, [1e6, 0.0])], "query_id long, embedding array<double>")
    near = spark.createDataFrame([(7, [1e6, 2e-3]), (8, [1e6, 1e-3]), (9, [1.0, 1.0])], "doc_id long, embedding array<double>")
    rows = dense.search(near, queries, 2, limit=limit).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(8, 1e-6), (7, 4e-6)]
    for bad in ([1.0], [1.0, None]):
        odd = near.unionByName(spark.createDataFrame([(5, bad)], near.schema))
        with pytest.raises(Exception, match="vector 5"):
            dense.search(odd, queries, 2, limit=limit).collect()
