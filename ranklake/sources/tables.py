"""Reading the raw files and reading and writing the engine's own tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ranklake.operators.passages import with_metadata
from ranklake.sources.schemas import PRODUCT_META, REVIEWS


class MissingInputError(FileNotFoundError):
    """An input does not exist; the message names the step that makes it."""


def _guarded(read, path: str, hint: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInputError(f"missing input {path}: {hint}") from error
        raise


def read_jsonl(
    spark: SparkSession, path: str, schema: StructType | None = None, sampling: float = 1.0
) -> DataFrame:
    """JSON lines, one object per line, read in parallel line ranges.

    With a schema, a malformed line fails the job.  Without one, the schema is
    inferred from a share of the lines, for exploration.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    else:
        reader = reader.option("samplingRatio", str(sampling))
    return _guarded(reader.json, path, "download the raw files first")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, REVIEWS)


def read_product_meta(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PRODUCT_META)


def write_products(products: DataFrame, path: str) -> None:
    """Replace the product table; missing parent folders are made."""
    products.write.mode("overwrite").parquet(path)


def read_products(spark: SparkSession, path: str, text_column: str | None = None) -> DataFrame:
    """The product table, or one text column and the metadata of it."""
    products = _guarded(spark.read.parquet, path, "build the product table first")
    return products if text_column is None else with_metadata(products, text_column)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Replace the vector table (``doc_id, embedding`` and metadata)."""
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _guarded(spark.read.parquet, path, "embed the passages first")


def row_counts(**tables: DataFrame) -> DataFrame:
    """``table_name, n_rows, n_columns`` of each table, in one job."""
    counts = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
        )
        counts = row if counts is None else counts.unionByName(row)
    return counts
