import pytest

from aguayo.functions.text import clean, strip
from aguayo.operators import keys
from aguayo.operators.checks import ValidationError


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_checked_join(spark):
    left = frame(spark, [("A  1", "l1", "keep"), ("B", "l2", "keep"), ("C", "l3", None)], "k string, v string, candidate_note string")
    right = frame(spark, [("A 1", "r1"), ("B ", "r2"), ("unused", None)], "id string, v string")
    got = {r._join_key: r for r in keys.checked_left_join(left, right, "k", "id", "candidate_", ["v"]).collect()}
    assert {k: (r.candidate_v, r._merge_status, r.candidate_note) for k, r in got.items()} == {"A 1": ("r1", "both", "keep"), "B": ("r2", "both", "keep"), "C": (None, "left_only", None)}
    with pytest.raises(ValidationError, match="both sides"):
        keys.checked_left_join(left, right.withColumnRenamed("v", "note"), "k", "id", "candidate_", ["note"])


@pytest.mark.parametrize("rows,rule", [([("", ""), ("a", ""), ("a", "")], "empty_key"), ([("null", "")], "empty_key"), ([("a", ""), (" a", "")], "duplicate_key")])
def test_key_rules_in_order(spark, rows, rule):
    with pytest.raises(ValidationError) as e:
        keys.require_unique_key(frame(spark, rows, "k string, v string"), "k", "t")
    assert e.value.rule == rule


def test_complete_match(spark):
    left = frame(spark, [("a",), ("b",)], "k string")
    j = keys.checked_left_join(left, frame(spark, [("a",)], "id string"), "k", "id", "p_", [])
    for n, rule in ((3, "row_count"), (2, "unmatched")):
        with pytest.raises(ValidationError) as e:
            keys.require_complete_match(j, n, "t")
        assert e.value.rule == rule


def test_audit_reproduces_published_shape(spark):
    left = spark.range(127).selectExpr("concat('k', id) AS id_fuente")
    right = spark.range(295).selectExpr("concat('k', id) AS id_objeto")
    got = {r.metric: r.value for r in keys.join_audit("MET", left, right, "id_fuente", "id_objeto").collect()}
    assert [got[m] for m in keys.AUDIT_METRICS] == [127.0, 295.0, 0.0, 0.0, 0.0, 0.0, 127.0, 0.0, 1.0, 168.0]


def test_audit_of_empty_and_dirty_tables(spark):
    none = frame(spark, [], "k string")
    got = {r.metric: r.value for r in keys.join_audit("X", none, none, "k", "k").collect()}
    assert set(got.values()) == {0.0} and len(got) == 10
    left = frame(spark, [("a",), ("a",), (None,), ("null",)], "k string")
    by = lambda n: {r.metric: r.value for r in keys.join_audit("X", left, frame(spark, [("a",)], "k string"), "k", "k", n).collect()}
    assert (by(strip)["reviewed_empty_keys"], by(strip)["missing_reviewed_keys"]) == (1.0, 1.0)
    assert (by(clean)["reviewed_empty_keys"], by(clean)["missing_reviewed_keys"], by(clean)["match_rate"]) == (2.0, 0.0, 0.25)


def test_latest_by_key_with_a_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(500)] + [("b ", 1, "x"), (" b", 1, "y"), ("", 9, "z"), (None, 9, "z")]
    got = {r.k.strip(): r.v for r in keys.latest_by_key(frame(spark, rows, "k string, t int, v string"), "k", ["t", "v"]).collect()}
    assert got == {"hot": "v499", "b": "y"}


def test_duplicates_and_missing_keys(spark):
    df = frame(spark, [(1, "a", None), (2, "a", None), (3, "b", "x"), (4, None, None), (5, None, None)], "i int, a string, b string")
    assert sorted(r.i for r in keys.duplicate_rows(df, ["a", "b"]).collect()) == [1, 2, 4, 5]
    l, r = frame(spark, [("a",), ("b",), ("c",), ("",)], "k string"), frame(spark, [("a",), ("z",)], "k string")
    assert sorted(x.key for x in keys.missing_keys(l, r, "k", "k").collect()) == ["b", "c"]
    assert [x.key for x in keys.first_missing_keys(l, r, "k", "k", 1).collect()] == ["b"]
    assert [x.key for x in keys.matched_keys(l, r, "k", "k").collect()] == ["a"]
