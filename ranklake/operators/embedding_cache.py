"""Embeddings kept by what they are made of: a text goes through a model once, whatever passages hold it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ranklake.functions.models import EmbedFactory, embedding

_SCHEMA = "text_key binary, embedding array<float>"


@dataclass(frozen=True)
class EmbeddingCache:
    """A table of embeddings under ``path``, by a hash of the model's name and the text.

    Each build adds a folder with what was missing.  A vector that two builds added at a time counts once.  A null
    text has the vector of the empty one.
    """

    path: str
    model: str

    def _key(self, text: Column) -> Column:
        whole = F.concat(F.lit(f"{len(self.model)}:{self.model}:"), F.coalesce(text, F.lit("")))
        return F.unhex(F.sha2(whole, 256))

    def stored(self, spark: SparkSession) -> DataFrame:
        """``text_key, embedding``."""
        try:
            kept = spark.read.option("recursiveFileLookup", "true").schema(_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], _SCHEMA)
        return kept.groupBy("text_key").agg(F.first("embedding").alias("embedding"))

    def embed(self, passages: DataFrame, factory: EmbedFactory, batch_size: int = 256) -> tuple[DataFrame, int]:
        """``passages`` with ``embedding``, and how many texts the model saw for it.

        Texts that the cache lacks are shuffled by key, so equal ones meet and go to the model once; all other
        texts stay where they are, and their keys are joined.
        """
        spark = passages.sparkSession
        keyed = passages.withColumn("text_key", self._key(F.col("content")))
        known = self.stored(spark).select("text_key")
        missing = keyed.select("text_key", F.coalesce("content", F.lit("")).alias("content")).join(known, "text_key", "left_anti").dropDuplicates(["text_key"])
        seen = Observation("embedded")
        made = missing.observe(seen, F.count(F.lit(1)).alias("n")).select("text_key", embedding(F.col("content"), factory, batch_size).cast("array<float>").alias("embedding"))
        made.write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return keyed.join(self.stored(spark), "text_key").drop("text_key"), seen.get.get("n") or 0
