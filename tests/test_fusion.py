from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ranklake.operators.fusion import rrf_fuse

SCHEMA = "query_id int, list_no int, rank int, doc_id string, parent_asin string, note string"


def frame(spark, lists):
    data = [
        (1, list_no, rank, doc, asin, f"{list_no}/{rank}")
        for list_no, items in enumerate(lists)
        for rank, (doc, asin) in enumerate(items, 1)
    ]
    return spark.createDataFrame(data, SCHEMA)


def expected(lists):
    """Fusion by the definition: sums of 1 / (60 + position), first sighting kept."""
    seen = {}
    for list_no, items in enumerate(lists):
        for position, (doc, asin) in enumerate(items, 1):
            key = ("doc", doc) if doc and doc.strip() else ("asin", asin) if asin else None
            if key:
                entry = seen.setdefault(key, [0.0, f"{list_no}/{position}", (list_no, position)])
                entry[0] += 1 / (60 + position)
    order = sorted(seen.values(), key=lambda e: (-round(e[0], 12), e[2]))
    return [(rank, round(score, 12), note) for rank, (score, note, _) in enumerate(order, 1)]


def fused(spark, lists):
    out = rrf_fuse(frame(spark, lists)).orderBy("rank").collect()
    return [(r["rank"], r["score"], r["note"]) for r in out]


def test_cases(spark):
    a, b, c = ("a", None), ("b", None), ("c", None)
    for lists in (
        [[a, b], [b, c]],
        [[a, b], []],
        [[], []],
        [[a, a, b], [b]],  # twice in one list counts twice
        [[(None, None), a], [(" ", ""), b]],  # keyless rows use up their position
        [[(None, "x"), a], [("", "x"), (" ", "a")]],  # products stand in for ids
        [[a, b], [b, a]],  # equal scores: first list first
    ):
        assert fused(spark, lists) == expected(lists)


def test_one_list_keeps_its_order(spark):
    lists = [[(x, None) for x in "dbca"]]
    assert [n for _, _, n in fused(spark, lists)] == ["0/1", "0/2", "0/3", "0/4"]


item = st.tuples(st.sampled_from(["a", "b", "c", "d", None, " "]), st.sampled_from(["a", "x", "", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lists=st.lists(st.lists(item, max_size=6), min_size=1, max_size=4))
def test_any_lists(spark, lists):
    assert fused(spark, lists) == expected(lists)
