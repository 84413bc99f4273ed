"""The product store: deliveries, versions and writers against a full build."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from ranklake.plans.product_table import product_table
from ranklake.sources import roles
from ranklake.sources.schemas import PRODUCT_META, REVIEWS
from ranklake.sources.snapshots import CommitConflict, SnapshotStore
from ranklake.streaming.refresh import ProductStore

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RAW = "parent_asin string, text string, rating double, helpful_vote long"


def metadata(spark, titles):
    rows = [(k, t, "c", 4.0, 1, "s", "1", ["f"], ["d"], ["k"], "{}") for k, t in titles]
    return spark.createDataFrame(rows, PRODUCT_META)


def by_id(df):
    return {r["parent_asin"]: r for r in df.collect()}


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_deliveries_equal_a_full_build(spark, tmp_path):
    store = ProductStore(f"{tmp_path}/store", buckets=4)
    first = metadata(spark, [(f"p{i}", f"T{i}") for i in range(20)])
    store.apply(spark, meta=first)
    taken = []
    for k, delivery in enumerate(([("p1", "one", 5.0, 1)], [("p1", "two", 4.0, 9), ("p2", "x", 1.0, None)], [("p9", " ", 1.0, 1)], [(None, "stray", 1.0, 1)],
                                  [("p1", f"more {i}", 3.0, i) for i in range(30)])):
        store.apply(spark, reviews=spark.createDataFrame(delivery, RAW), batch=("s", k))
        taken += delivery
    # New and changed metadata without any review; of two rows for one product the greater one counts.
    changed = metadata(spark, [("p1", "changed"), ("p3", "a"), ("p3", "b"), ("new", "N"), (None, "no id")])
    store.apply(spark, meta=changed)
    titles = {f"p{i}": f"T{i}" for i in range(20)} | {"p1": "changed", "p3": "b", "new": "N", None: "no id"}
    want = product_table(spark.createDataFrame(taken, RAW), metadata(spark, list(titles.items())))
    assert rows_of(store.products(spark)) == rows_of(want)
    # Best ten of a product are kept, not its history.
    kept = store._store.read(spark, "reviews", store._store.manifest(spark))
    assert kept.filter("parent_asin = 'p1'").count() == 10


def test_repeated_batches_and_empty_deliveries_change_nothing(spark, tmp_path):
    store = ProductStore(f"{tmp_path}/store", buckets=4)
    store.apply(spark, meta=metadata(spark, [("p1", "T")]))
    review = spark.createDataFrame([("p1", "one", 5.0, 1)], RAW)
    store.apply(spark, reviews=review, batch=("s", 0))
    before, version = rows_of(store.products(spark)), store.version(spark)
    store.apply(spark, reviews=review, batch=("s", 0))
    store.apply(spark, reviews=review.limit(0))
    store.apply(spark, meta=metadata(spark, []))
    assert store.version(spark) == version and rows_of(store.products(spark)) == before
    store.apply(spark, reviews=review.limit(0), batch=("s", 1))
    assert rows_of(store.products(spark)) == before
    # Another stream's batch of the same number is its own.
    store.apply(spark, reviews=review.withColumn("text", F.lit("two")), batch=("other", 0))
    assert by_id(store.products(spark))["p1"]["review_texts"] == "one two"


def test_reviews_before_their_product(spark, tmp_path):
    store = ProductStore(f"{tmp_path}/store", buckets=2)
    store.apply(spark, reviews=spark.createDataFrame([("p1", "early", 5.0, 1)], RAW))
    assert store.products(spark).count() == 0
    store.apply(spark, meta=metadata(spark, [("p1", "T"), ("p2", "U")]))
    got = by_id(store.products(spark))
    assert got["p1"]["review_texts"] == "early" and got["p2"]["review_texts"] == ""


def test_readers_stay_with_their_version(spark, tmp_path):
    store = ProductStore(f"{tmp_path}/store", buckets=4)
    store.apply(spark, meta=metadata(spark, [(f"p{i}", "old") for i in range(9)]))
    reader, version = store.products(spark), store.version(spark)
    for i in range(3):
        store.apply(spark, meta=metadata(spark, [(f"p{i}", "new")]))
    assert {r["product_title"] for r in reader.collect()} == {"old"}
    assert {r["product_title"] for r in store.products(spark, version).collect()} == {"old"}
    titles = sorted(r["product_title"] for r in store.products(spark).collect())
    assert titles == ["new"] * 3 + ["old"] * 6
    assert store.vacuum(spark, keep=1) > 0
    assert sorted(r["product_title"] for r in store.products(spark).collect()) == titles
    with pytest.raises(LookupError):
        store.products(spark, version)


def test_a_writer_that_came_second_begins_anew(spark, tmp_path, monkeypatch):
    store = ProductStore(f"{tmp_path}/store", buckets=1)
    store.apply(spark, meta=metadata(spark, [("p1", "T")]))
    commit, raced = SnapshotStore.commit, []

    def race(self, spark, manifest, batch=None):
        if not raced:
            raced.append(True)
            store.apply(spark, reviews=spark.createDataFrame([("p1", "first", 5.0, 2)], RAW))
        return commit(self, spark, manifest, batch)

    monkeypatch.setattr(SnapshotStore, "commit", race)
    store.apply(spark, reviews=spark.createDataFrame([("p1", "second", 5.0, 1)], RAW))
    assert by_id(store.products(spark))["p1"]["review_texts"] == "first second"
    old = store._store.manifest(spark, 0)
    with pytest.raises(CommitConflict):
        commit(store._store, spark, old)
    drafts = [f for f in os.listdir(f"{tmp_path}/store/manifests") if f.startswith("draft")]
    assert not drafts


def test_a_delivery_is_read_once(spark, tmp_path):
    store = ProductStore(f"{tmp_path}/store", buckets=4)
    os.makedirs(f"{tmp_path}/read")

    def noted(rows):
        def note(batches):
            for batch in batches:
                with open(f"{tmp_path}/read/{uuid.uuid4().hex}", "w") as f:
                    f.write("x" * batch.num_rows)
                yield batch

        return rows.mapInArrow(note, rows.schema)

    def n_read():
        return sum(os.path.getsize(f"{tmp_path}/read/{f}") for f in os.listdir(f"{tmp_path}/read"))

    meta = metadata(spark, [("p1", "T"), ("p2", "U"), (None, "no id")])
    store.apply(spark, meta=noted(meta))
    assert n_read() == 3
    reviews = spark.createDataFrame([("p1", "one", 5.0, 1), ("p1", "two", 4.0, None), ("p2", "x", 1.0, 2), (None, "stray", 1.0, 1)], RAW)
    store.apply(spark, reviews=noted(reviews), batch=("s", 0))
    assert n_read() == 7
    store.apply(spark, reviews=noted(reviews), batch=("s", 0))  # known, so not read at all
    assert n_read() == 7
    assert rows_of(store.products(spark)) == rows_of(product_table(reviews, meta))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_streams_of_every_checkpoint(spark, tmp_path):
    meta, reviews = roles.product_meta(spark, SF_DIR), roles.reviews(spark, SF_DIR)
    store = ProductStore(f"{tmp_path}/store", buckets=4)
    store.apply(spark, meta=meta)
    for i, delivery in enumerate((F.col("rating") <= 3, F.col("rating") > 3)):
        reviews.filter(delivery).write.json(f"{tmp_path}/in{i}")
        incoming = spark.readStream.schema(REVIEWS).json(f"{tmp_path}/in{i}")
        for _ in range(2):  # the second run finds nothing new
            store.refresh_reviews(incoming, f"{tmp_path}/checkpoint{i}").awaitTermination()
    columns = ["parent_asin", "review_texts", "text_bm25"]
    assert rows_of(store.products(spark).select(*columns)) == rows_of(product_table(reviews, meta).select(*columns))
