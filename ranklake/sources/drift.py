"""JSON lines whose files disagree on types: what each file has, one schema for all, and where they differ.

Merge rule for the values of a key, nulls aside: one type stays; whole and other numbers become double; anything else
becomes text, numbers as written and objects and lists as their JSON.  A key without any value is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ranklake.sources.tables import _guarded

#: Types as they are reported; a key of lists or objects only is read by inference.
_SIMPLE = ("boolean", "long", "double", "string")


def key_types(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, type, n``: how many values of each type a key has in each file, nulls aside.

    One pass over the lines; counts are combined before their shuffle.
    """
    lines = _guarded(spark.read.text, path, "download the raw files first")
    rows = lines.filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    each = rows.select("file", F.explode(F.variant_get("v", "$", "map<string,variant>")).alias("key", "value"))
    kind = _kind(F.schema_of_variant("value"))
    return each.select("file", "key", kind.alias("type")).filter(F.col("type") != "null").groupBy("file", "key", "type").agg(F.count(F.lit(1)).alias("n"))


def _kind(name: Column) -> Column:
    return (
        F.when(name == "VOID", "null")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "BIGINT", "long")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "double")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .otherwise("string")
    )


def _merged(types: DataFrame) -> DataFrame:
    """``key, types, merged, n_values``, one row a key."""
    kinds = F.array_sort(F.collect_set("type"))
    by_key = types.groupBy("key").agg(kinds.alias("kinds"), F.sum("n").alias("n_values"))
    both = F.array(F.lit("double"), F.lit("long"))
    merged = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(F.col("kinds") == both, "double").otherwise("string")
    return by_key.select("key", F.array_join("kinds", ", ").alias("types"), merged.alias("merged"), "n_values")


def conflicts(types: DataFrame) -> DataFrame:
    """``key, types, merged, n_values`` of the keys that have values of more than one type."""
    return _merged(types).filter(F.contains("types", F.lit(",")))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """All files by one schema.  Keys of lists or objects only keep the shape that Spark infers for them."""
    # One row a key.
    merged = {row["key"]: row["merged"] for row in _merged(key_types(spark, path)).collect()}
    nested = [k for k, kind in merged.items() if kind not in _SIMPLE]
    shapes = {f.name: f for f in spark.read.json(path).schema.fields} if nested else {}
    schema = StructType()
    for key in sorted(merged):
        schema = schema.add(shapes[key]) if key in nested else schema.add(key, merged[key])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
