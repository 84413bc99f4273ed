import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from ranklake.operators import profile, sketches
from ranklake.sources import feedback, roles
from ranklake.sources.schemas import FEEDBACK
from ranklake.sources.tables import row_counts
from ranklake.streaming.feedback import ingest_feedback


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(2)
    a = rng.normal(size=700).round(2)
    a[:250] = 0.5  # a third of all rows share one value
    return a.tolist(), rng.integers(0, 6, size=700).astype(float).tolist()


@pytest.mark.parametrize("ranked", [1_000_000, 40, 3, 0])
def test_exact_quantiles(spark, numbers, ranked):
    df = spark.createDataFrame(
        [(x, y) for x, y in zip(*numbers)] + [(None, float("nan"))], "a double, b double")
    probabilities = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}
    got = {r["column_name"]: r for r in
           profile.exact_quantiles(df, ["a", "b"], probabilities, ranked).collect()}
    for name, values in zip("ab", numbers):
        for q, p in probabilities.items():
            assert got[name][q] == pytest.approx(np.quantile(values, p))


def test_quantiles_of_many_values_take_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    skewed = np.exp(rng.normal(size=60_000) * 4)
    df = spark.createDataFrame([(float(x), 1.0, None) for x in skewed], "a double, b double, c double")
    passes, narrow = [], profile._narrow

    def counted(values, numbers, brackets):
        passes.append(max(b.inside for b in brackets))
        narrow(values, numbers, brackets)

    monkeypatch.setattr(profile, "_narrow", counted)
    got = {r["column_name"]: r for r in profile.exact_quantiles(df, ["a", "b", "c"], {"q1": 0.01, "q50": 0.5, "q90": 0.9}, 300).collect()}
    assert [got["a"][q] for q in ("q1", "q50", "q90")] == pytest.approx(np.quantile(skewed, [0.01, 0.5, 0.9]).tolist())
    assert (got["b"]["q50"], got["c"]["q50"]) == (1.0, None)
    assert 1 <= len(passes) <= 4 and all(b < 0.2 * a for a, b in zip(passes, passes[1:]))
    none = profile.exact_quantiles(df.limit(0), ["a"], {"q50": 0.5}).collect()
    assert [tuple(r) for r in none] == [("a", None)]


def test_describe(spark, numbers):
    df = spark.createDataFrame([(x,) for x in numbers[0]], "a double")
    [row] = profile.describe(df, ["a"]).collect()
    assert row["n"] == 700
    assert row["stddev"] == pytest.approx(np.std(numbers[0], ddof=1))


def test_small_reports(spark, rows):
    df = spark.createDataFrame(
        [(1, "x", True), (2, "x", False), (3, "y", True), (4, None, None)], "k int, c string, b boolean")
    assert rows(profile.column_means(df, ["k", "b"])) == [("b", pytest.approx(2 / 3)), ("k", 2.5)]
    assert rows(profile.null_shares(df)) == [("b", 0.25), ("c", 0.25), ("k", 0.0)]
    assert rows(profile.info(df)) == [("b", "boolean", 3), ("c", "string", 3), ("k", "int", 4)]
    shares = profile.value_shares(df, "c").collect()
    assert [r["value"] for r in shares] == ["x", "y"]
    assert [r["percent"] for r in shares] == pytest.approx([200 / 3, 100 / 3])
    assert [tuple(r) for r in profile.top_values(df, "c", 1).collect()] == [("x", 2)]
    assert rows(profile.distinct_count(df, "c")) == [("c", 2)]
    assert rows(row_counts(t=df)) == [("t", 4, 3)]
    assert [r["k"] for r in profile.row_at(df, ["k"], 1, 2).collect()] == [2, 3]
    drawn = profile.sample_rows(df, "k", "s", 2)
    assert drawn.collect() == profile.sample_rows(df.repartition(3), "k", "s", 2).collect()


def test_time_profile(spark):
    df = spark.createDataFrame([(1514764800000,), (1514764800001,), (0,)], "ms long")
    df = df.select(profile.from_epoch_millis(F.col("ms")).alias("ts"))
    [row] = profile.time_profile(df, "ts", "2018-01-01").collect()
    assert row["n_after"] == 1 and str(row["latest_day"]) == "2018-01-01"


VOTE = "query string, mode string, parent_asin string, title string, feedback string"


def test_feedback_log(spark, tmp_path):
    votes = spark.createDataFrame(
        [('say "hi", you', "Hybrid", "A", "two\nlines", "up"), ("q", "BM25", "B", "T", "down"),
         ("q", "BM25", "B", "T", "maybe")], VOTE)
    path = str(tmp_path / "log" / "feedback")
    feedback.append_feedback(feedback.feedback_rows(votes.filter("feedback = 'up'")), path)
    feedback.append_feedback(feedback.feedback_rows(votes.filter("feedback <> 'up'")), path)
    got = feedback.read_feedback(spark, path)
    assert got.columns == FEEDBACK.fieldNames()
    by_vote = {r["feedback"]: r for r in got.collect()}
    assert set(by_vote) == {"up", "down"}
    assert by_vote["up"]["query"] == 'say "hi", you' and by_vote["up"]["title"] == "two\nlines"
    assert by_vote["up"]["timestamp"].endswith("+00:00")


def test_rows_by_position(spark):
    df = spark.createDataFrame([(i // 3, f"r{i}") for i in range(300)], "k int, name string").repartition(5)
    index = profile.position_index(df, ["k"], ranges=6)
    assert index.total == 300 and len(index.offsets) > 1
    whole = [r["name"] for r in sorted((r for p in range(0, 300, 50) for r in index.at(p, 50).collect()), key=lambda r: r["k"])]
    assert sorted(whole) == sorted(f"r{i}" for i in range(300))
    for position in (0, 74, 149, 299):
        assert [r["k"] for r in index.at(position).collect()] == [position // 3]
    assert [r["k"] for r in index.at(295, 50).orderBy("k").collect()] == [98] * 2 + [99] * 3
    # Only the ranges with those rows are read.
    assert "_part#" in plan_of(index.at(200, 2)).split("PartitionFilters")[1][:80]
    assert index.at(300).count() == index.at(5, 0).count() == profile.position_index(df.limit(0), ["k"]).at(0).count() == 0


def test_sketches_of_deliveries_combine(spark, tmp_path):
    path = f"{tmp_path}/sketches"
    first = spark.createDataFrame([("hot",)] * 500 + [(f"a{i}",) for i in range(400)] + [(None,)], "v string")
    second = spark.createDataFrame([("hot",)] * 100 + [("warm",)] * 300 + [(f"b{i}",) for i in range(300)], "v string")
    sketches.append(first, ["v"], path, "1")
    sketches.append(second, ["v"], path, "2")
    sketches.append(second, ["v"], path, "2")  # the same delivery again
    both = sketches.combined(spark, path)
    assert both.first()["n"] == 1600
    top = {r["value"]: (r["n"], r["error"]) for r in sketches.top_values(both, 2).collect()}
    assert top.keys() == {"hot", "warm"} and abs(top["hot"][0] - 600) <= top["hot"][1] + 1e-9 and abs(top["warm"][0] - 300) <= top["warm"][1] + 1e-9
    [d] = sketches.distinct_counts(both).collect()
    assert abs(d["n_distinct"] - 702) <= d["error"]
    [one] = sketches.distinct_counts(sketches.combined(spark, path, ["2"])).collect()
    assert abs(one["n_distinct"] - 302) <= one["error"]


def test_repeated_events_are_written_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "event_id long, at timestamp, query string, mode string, parent_asin string, title string, feedback string"

    def deliver(*events):
        rows = [(i, datetime.datetime.fromisoformat(t), "q", "m", "p", "t", vote) for i, t, vote in events]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest_feedback(spark.readStream.schema(schema).parquet(source), path, checkpoint, event_id="event_id", delay="1 day").awaitTermination()

    deliver((1, "2024-01-01T00:00:00", "up"), (1, "2024-01-01T00:00:00", "up"), (2, "2024-01-01T01:00:00", "down"), (3, "2024-01-01T02:00:00", None))
    deliver((1, "2024-01-01T00:00:00", "up"), (4, "2024-01-01T03:00:00", "up"), (5, "2024-01-09T00:00:00", "up"))
    deliver((5, "2024-01-09T00:00:00", "up"), (4, "2024-01-01T03:00:00", "up"), (6, "2024-01-08T12:00:00", "down"))
    got = spark.read.parquet(path)
    assert got.count() == 5 and got.filter("feedback = 'down'").count() == 2


def test_feedback_stream_restarts_without_repeating(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    events = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", 7, "click", "{}"), (2, "2024-01-01 00:00:01", 8, "view", "{}")],
        "event_id long, ts string, user_id long, event_type string, props string")
    for _ in range(2):
        events.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)
        for _ in range(2):
            stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
            rows = feedback.feedback_rows(roles.as_votes(stream), F.col("at"))
            ingest_feedback(rows, path, checkpoint).awaitTermination()
    got = spark.read.parquet(path).collect()
    assert [r["feedback"] for r in got] == ["up", "up"]
    assert got[0]["timestamp"] == "2024-01-01T00:00:00.000000+00:00"
