import json

import pytest
from pyspark.sql import functions as F

from ranklake.operators import expansion

RESPONSES = [
    ('["a", "b"]', ["a", "b"]),
    ('Sure:\n```json\n[" a ", "", "b"]\n```\nmore ["no"]', ["a", "b"]),
    ("```\n[\"x\"]\n```", ["x"]),
    ('text ["a", 1, null, true] tail', ["a", "1", "None", "True"]),
    ("[1.0, 2.50, 3, -0.5]", ["1.0", "2.5", "3", "-0.5"]),
    ("[]", []),
    ("no array", None),
    ("]x[", None),
    ('["a" "b"]', None),
    ('["a"] and ["b"]', None),
    ("[a]", None),
    ("``` none ``` [\"a\"]", None),
    (json.dumps(["é\n", "　wide　", "q\"uote"]), ["é", "wide", "q\"uote"]),
    (None, None),
]


def test_parse_json_array(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RESPONSES)], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(expansion.parse_json_array(F.col("r"))).collect()]
    assert got == [e for _, e in RESPONSES]


def test_expand(spark, rows):
    queries = spark.createDataFrame(
        [(1, " one "), (2, "two"), (3, "three"), (4, "  "), (5, "five"), (6, "six")], "query_id int, query string")
    responses = spark.createDataFrame(
        [(1, '["v1", "one", " v1 ", "v2", "v3"]'), (2, "sorry"), (4, '["v"]'), (5, '[" ", "w"]'), (6, '["a" "b"]')],
        "query_id int, raw_response string")
    variants, warnings = expansion.expand(queries, responses, 3)
    assert rows(variants) == [
        (1, 0, "one"), (1, 1, "v1"), (2, 0, "two"), (3, 0, "three"), (5, 0, "five"), (5, 1, "w"), (6, 0, "six")]
    assert rows(warnings) == [
        (2, expansion.EXPANSION_FAILED), (3, expansion.NO_RESPONSE), (4, "Empty query."), (6, expansion.MALFORMED_ARRAY)]


def test_requests(spark, rows):
    queries = spark.createDataFrame([(1, " best game "), (2, " ")], "query_id int, query string")
    [(query_id, request)] = rows(expansion.expansion_requests(queries, 4))
    assert query_id == 1 and request.startswith("User query:\nbest game\n\nReturn ONLY")
    assert "exactly 4 strings" in request
