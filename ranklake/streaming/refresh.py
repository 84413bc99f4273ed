"""Keeping the product table current as reviews and metadata are delivered."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ranklake.operators.products import PRODUCT_COLUMNS
from ranklake.operators.reviews import TOP_N_REVIEWS, rank_reviews
from ranklake.plans.product_table import product_table
from ranklake.sources.schemas import PRODUCT_META
from ranklake.sources.snapshots import CommitConflict, Manifest, SnapshotStore
from ranklake.sources.storage import discard, stored

_REVIEW_COLUMNS = ("parent_asin", "text", "rating", "helpful_vote")


@dataclass(frozen=True)
class ProductStore:
    """The product table and what it is made of, in versions by product bucket.

    Kept of the reviews are each product's best ``top_n``: the best of those and of a delivery's are the best
    of all, so no review is read twice and the state is bounded by the number of products.  Kept of the
    metadata is each product's latest row.  A delivery rewrites the buckets it touches, in all three tables,
    and one rename publishes them together; readers in the middle stay with the version they began with.

    Defined cases: reviews without a product id are left out; of several metadata rows for one product in a
    delivery the greatest counts; metadata rows without a product id are products of their own and pile
    up; a delivery that was taken before, or that is empty, changes nothing.
    """

    path: str
    buckets: int = 512
    top_n: int = TOP_N_REVIEWS

    @property
    def _store(self) -> SnapshotStore:
        return SnapshotStore(self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("parent_asin"), F.lit(self.buckets)).cast("int")

    # -- deliveries --

    def refresh_reviews(self, incoming: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in the review deliveries that are new since the last run, then stops."""
        return self._stream(incoming, checkpoint, "reviews")

    def refresh_metadata(self, incoming: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in new and changed metadata, then stops; needs no review to arrive."""
        return self._stream(incoming, checkpoint, "meta")

    def _stream(self, incoming: DataFrame, checkpoint: str, kind: str) -> StreamingQuery:
        def take(batch: DataFrame, number: int) -> None:
            # The id of the stream is kept in the checkpoint, so a repeated batch is known by it.
            stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.apply(batch.sparkSession, **{kind: batch}, batch=(stream, number))

        return (
            incoming.writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def apply(
        self,
        spark: SparkSession,
        *,
        reviews: DataFrame | None = None,
        meta: DataFrame | None = None,
        batch: tuple[str, int] | None = None,
    ) -> Manifest:
        """Takes in a delivery and publishes it; begins anew when another writer was first."""

        def known(base: Manifest) -> bool:
            return batch is not None and base.batches.get(batch[0], -1) >= batch[1]

        base = self._store.manifest(spark)
        if known(base):
            return base
        # A batch of a stream is parsed whole, with every column, each time that it is used.
        if reviews is not None:
            reviews = stored(reviews.select(*_REVIEW_COLUMNS).filter(F.col("parent_asin").isNotNull()), "delivery")
        if meta is not None:
            meta = stored(meta.select(*PRODUCT_META.fieldNames()), "delivery")
        try:
            while True:
                try:
                    return self._apply(spark, base, reviews, meta, batch)
                except CommitConflict:
                    base = self._store.manifest(spark)
                    if known(base):
                        return base
        finally:
            discard(*[df for df in (reviews, meta) if df is not None])

    def _apply(self, spark, base: Manifest, reviews, meta, batch) -> Manifest:
        # Versions are named anew in each attempt: a folder that a manifest names is never written again.
        tag, store, new = uuid.uuid4().hex, self._store, base
        # At most ``buckets`` numbers.
        touched = sorted({r[0] for df in (reviews, meta) if df is not None for r in df.select(self._bucket()).distinct().collect()})
        if not touched:
            return store.commit(spark, base, batch) if batch else base
        if reviews is not None:
            new = store.write(self._placed(self._best(spark, base, reviews, touched)), "reviews", new, touched, tag)
        if meta is not None:
            new = store.write(self._placed(self._latest(spark, base, meta, touched)), "meta", new, touched, tag)
        # Built from what was just written, so that nothing is ranked twice.
        best, latest = (self._read(spark, t, new, touched) for t in ("reviews", "meta"))
        products = product_table(best, latest, self.top_n, hot_rows=None)  # none is hot: at most ``top_n`` are kept
        new = store.write(self._placed(products), "products", new, touched, tag)
        return store.commit(spark, new, batch)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self._bucket())

    def _read(self, spark: SparkSession, table: str, manifest: Manifest, buckets: list[int]) -> DataFrame:
        if table in manifest.schemas:
            return self._store.read(spark, table, manifest, buckets)
        if table == "meta":
            return spark.createDataFrame([], PRODUCT_META)
        return spark.createDataFrame([], "parent_asin string, text string, rating double, helpful_vote long")

    def _best(self, spark: SparkSession, base: Manifest, reviews: DataFrame, touched: list[int]) -> DataFrame:
        ranked = rank_reviews(self._read(spark, "reviews", base, touched).unionByName(reviews), self.top_n)
        return ranked.select("parent_asin", F.col("review_text").alias("text"), "rating", F.col("votes").alias("helpful_vote"))

    def _latest(self, spark: SparkSession, base: Manifest, meta: DataFrame, touched: list[int]) -> DataFrame:
        known = self._read(spark, "meta", base, touched).withColumn("_new", F.lit(False))
        every = known.unionByName(meta.withColumn("_new", F.lit(True)))
        row = F.struct(*[F.col(c) for c in PRODUCT_META.fieldNames()])
        newest = Window.partitionBy("parent_asin").orderBy(F.col("_new").desc(), row.desc())
        # A delivery is shuffled by product once; rows without an id are spread over the rank's other branch.
        named = every.filter(F.col("parent_asin").isNotNull()).withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1")
        return named.drop("_rn", "_new").unionByName(every.filter(F.col("parent_asin").isNull()).drop("_new"))

    # -- readers --

    def version(self, spark: SparkSession) -> int:
        """Number of the newest version, for readers that want to stay with it."""
        return self._store.manifest(spark).number

    def products(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The product table, of the newest version or of a given one."""
        return self._store.read(spark, "products", self._store.manifest(spark, version)).select(*PRODUCT_COLUMNS)

    def vacuum(self, spark: SparkSession, keep: int = 10) -> int:
        """Deletes what only versions before the last ``keep`` need."""
        return self._store.vacuum(spark, keep)
