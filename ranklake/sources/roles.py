"""The test tables in the roles of the engine's inputs.

Every role reads its whole table; values are derived by expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def product_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products from ``part``; some have no store, price, features or description."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("main_category"),
        F.round(size / 10.0, 1).alias("average_rating"),
        size.cast("long").alias("rating_number"),
        F.nullif(F.col("p_brand"), F.lit("Brand#7")).alias("store"),
        F.when(size > 40, F.lit(" ")).otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(size < 15, F.array().cast("array<string>"))
        .otherwise(F.split("p_name", " "))
        .alias("features"),
        F.when(F.col("p_type") != "SMALL", F.array("p_type")).alias("description"),
        F.array("p_type", "p_brand").alias("categories"),
        F.concat(F.lit('{"size":'), size.cast("string"), F.lit("}")).alias("details"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews from ``lineitem``; untaxed lines have a blank text."""
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string"))
    return _reviews(spark, sf_dir, F.when(F.col("l_tax") == 0, F.lit("   ")).otherwise(text))


def sparse_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews where only returned and finished lines have a text: some products have none."""
    commented = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0)
    return _reviews(
        spark, sf_dir, F.when(commented, F.concat(F.lit("returned "), F.col("l_orderkey").cast("string")))
    )


def _reviews(spark, sf_dir, text) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("parent_asin"),
        text.alias("text"),
        F.col("l_linenumber").cast("double").alias("rating"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity").cast("long")).alias("helpful_vote"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), "lang", "source"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def product_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names and types of products, as queries against the product table."""
    part = table(spark, sf_dir, "part")
    return part.select(F.concat_ws(" ", "p_name", "p_type").alias("query")).distinct().select(
        F.md5("query").alias("query_id"), "query"
    )


def mode_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with a mode label that depends on their length."""
    n = F.length("query")
    label = (
        F.when(n < 150, F.lit(" Semantic "))
        .when(n < 220, F.lit("BM25"))
        .when(n < 300, F.lit("hybrid"))
        .otherwise(F.lit("other"))
    )
    return queries(spark, sf_dir).withColumn("mode", label)


def conversation_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and responses from ``conversations``.

    The first user turn is the query.  All later ones are the response, as a
    fenced JSON array (often more than the variants asked for, so that some are cut);
    a conversation without them has a response that holds no array.
    """
    turn_no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(F.col("conv_id").alias("query_id"), turn_no.alias("turn_no"), "text")
    )
    first = turns.filter("turn_no = 1").select("query_id", F.col("text").alias("query"))
    later = turns.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("turn_no") > 1, F.struct("turn_no", "text")))).alias("t")
    )
    fenced = F.concat(F.lit("Here you go:\n```json\n"), F.to_json("t.text"), F.lit("\n```"))
    responses = later.select(
        "query_id",
        F.when(F.size("t") > 0, fenced).otherwise(F.lit("I have no idea.")).alias("raw_response"),
    )
    return first, responses


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_votes(table(spark, sf_dir, "events"))


def as_votes(events: DataFrame) -> DataFrame:
    """Clicks as up votes and errors as down votes; other events are no votes."""
    return events.select(
        F.col("ts").cast("timestamp").alias("at"),
        F.col("props").alias("query"),
        F.lit("Hybrid").alias("mode"),
        F.col("user_id").cast("string").alias("parent_asin"),
        F.col("event_id").cast("string").alias("title"),
        F.when(F.col("event_type") == "click", F.lit("up"))
        .when(F.col("event_type") == "error", F.lit("down"))
        .alias("feedback"),
    )
