"""Query clean-up and expansion into variants, around a batch text-generation job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.functions.text import is_blank, strip

DEFAULT_NUM_VARIANTS = 3

# Warning texts.
EMPTY_QUERY = "Empty query."
EXPANSION_FAILED = "Query expansion failed (No JSON array found in model response); using original query only."
MALFORMED_ARRAY = "Query expansion failed (Malformed JSON array in model response); using original query only."
NO_RESPONSE = "Query expansion failed (No model response); using original query only."

# Request text, before and after the query and around the variant count.
REQUEST_HEAD = "User query:\n"
REQUEST_ASK = "\n\nReturn ONLY a JSON array of exactly "
REQUEST_TAIL = (
    " strings. Each string must be a different paraphrase of the user query for search. "
    "No other text or markdown."
)


def clean_queries(queries: DataFrame, column: str = "query") -> DataFrame:
    """Strip queries and drop the blank ones."""
    return queries.withColumn(column, strip(F.col(column))).filter(F.col(column) != "")


def expansion_requests(queries: DataFrame, num_variants: int = DEFAULT_NUM_VARIANTS) -> DataFrame:
    """One prompt per non-blank query, the input of a batch inference job."""
    return clean_queries(queries).select(
        "query_id",
        F.concat(
            F.lit(REQUEST_HEAD), F.col("query"), F.lit(f"{REQUEST_ASK}{num_variants}{REQUEST_TAIL}")
        ).alias("request"),
    )


def array_text(text: Column) -> Column:
    """What should be a JSON array in a model response; NULL where there is none.

    The body of the first code fence is used if there is one; in it, the text
    from the first ``[`` to the last ``]``.
    """
    # What stands between the first two fence marks, without the language named there.
    parts = F.split(text, "```")
    inside = F.get(parts, F.lit(1))
    unnamed = F.when(inside.startswith("json"), F.substr(inside, F.lit(len("json") + 1))).otherwise(inside)
    body = F.when(F.size(parts) > 2, unnamed).otherwise(text)
    return F.nullif(F.regexp_extract(body, r"(\[[\s\S]*\])", 1), F.lit(""))


def parse_json_array(text: Column) -> Column:
    """Strings of the JSON array in a model response; NULL where there is no valid one.  Blank items are dropped."""
    # As a field value, anything after the end of the array is a syntax error.
    document = F.try_parse_json(F.concat(F.lit('{"items":'), array_text(text), F.lit("}")))
    items = F.variant_get(document, "$.items", "array<variant>")
    return F.filter(F.transform(items, lambda item: strip(_as_text(item))), lambda t: t != "")


def _as_text(item: Column) -> Column:
    """Whole numbers and texts as written, other numbers with a fraction; objects and lists as JSON."""
    kind = F.schema_of_variant(item)
    text = F.try_variant_get(item, "$", "string")
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(item, "$", "double").cast("string"))
        .otherwise(text)
    )


def all_queries(original: Column, variants: Column) -> Column:
    """Original and variants: stripped, blanks dropped, first occurrences kept in order."""
    listed = F.concat(F.array(original), F.coalesce(variants, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(listed, strip), lambda q: q != ""))


def numbered(queries: DataFrame, variants: str = "variants") -> DataFrame:
    """One row per query and variant; variant 0 is the original."""
    return queries.select(
        "query_id",
        F.posexplode(all_queries(F.col("query"), F.col(variants))).alias("variant_no", "query"),
    )


def expand(
    queries: DataFrame, responses: DataFrame, num_variants: int = DEFAULT_NUM_VARIANTS
) -> tuple[DataFrame, DataFrame]:
    """Variants and warnings for a table of queries.

    ``responses`` holds ``query_id, raw_response``.  A query whose response is
    missing or unreadable keeps its original text and gets a warning that tells whether there is
    none, one without an array, or one whose array is malformed; a blank query gets a warning only.  Of several responses to one query the first in
    the order of their text counts.
    """
    one = responses.groupBy("query_id").agg(F.min("raw_response").alias("raw_response"))
    joined = (
        queries.select("query_id", "query")
        .join(one, "query_id", "left")
        .withColumn("parsed", parse_json_array(F.col("raw_response")))
    )
    usable = joined.filter(~is_blank(F.col("query"))).withColumn(
        "variants", F.slice("parsed", 1, num_variants)
    )
    warnings = joined.select(
        "query_id",
        F.when(is_blank(F.col("query")), F.lit(EMPTY_QUERY))
        .when(F.col("raw_response").isNull(), F.lit(NO_RESPONSE))
        .when(array_text(F.col("raw_response")).isNull(), F.lit(EXPANSION_FAILED))
        .when(F.col("parsed").isNull(), F.lit(MALFORMED_ARRAY))
        .alias("warning"),
    ).filter(F.col("warning").isNotNull())
    return numbered(usable), warnings
