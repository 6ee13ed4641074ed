from hypothesis import given, settings
from hypothesis import strategies as st

from aguayo.functions.text import clean_py
from aguayo.operators.diff import diff_copies

VALUE = st.sampled_from([None, "", "nan", "a", " a ", "b", "a  b", "a b", "A"])
ROW = st.tuples(st.sampled_from(["k1", " k1", "k2", "k3", None, "null", "k4"]), VALUE, VALUE)


def brute(a, b):
    def side(rows):
        out = {}
        for k, *v in rows:
            if clean_py(k):
                v = [clean_py(x) for x in v]
                out[clean_py(k)] = [max(p) for p in zip(out.get(clean_py(k), v), v)]
        return out

    x, y = side(a), side(b)
    return sorted([(k, "only_main") for k in x.keys() - y.keys()] + [(k, "only_mirror") for k in y.keys() - x.keys()] + [(k, f) for k in x.keys() & y.keys() for f, p, q in zip("uv", x[k], y[k]) if p != q])


@settings(max_examples=12, deadline=None)
@given(st.lists(ROW, max_size=8), st.lists(ROW, max_size=8))
def test_against_brute_force(spark, a, b):
    schema = "key string, u string, v string"
    got = diff_copies(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "key", ["u", "v"])
    assert sorted(map(tuple, got.collect())) == brute(a, b)


def test_hot_key_long_values_and_extra_columns(spark):
    a = spark.createDataFrame([("hot", "x" * 100_000, 1)] * 300 + [(f"k{i}", "v", i) for i in range(200)], "id string, f0 string, k int")
    b = spark.createDataFrame([("hot", "x" * 99_999, 1)] + [(f"k{i}", "v" if i % 2 else "w", i) for i in range(1, 201)], "id string, f0 string, s int")
    got = sorted(map(tuple, diff_copies(a, b, "id", ["f0"]).collect()))
    assert got == sorted([("hot", "f0"), ("k0", "only_main"), ("k200", "only_mirror")] + [(f"k{i}", "f0") for i in range(2, 200, 2)])


def test_hot_key_whose_rows_disagree(spark):
    a = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS id", "concat('v', id) AS u")
    b = spark.createDataFrame([("hot", "v999")], "id string, u string")
    got = sorted(map(tuple, diff_copies(a, b, "id", ["u"]).collect()))
    assert len(got) == 2_000 and ("hot", "u") not in got  # v999 is the greatest value on both sides
