import math

from pyspark.sql import functions as F

from aguayo.operators.masks import changes, load_metrics, mask, mask_divergence, mask_table, mask_violations, profile


def test_mask(spark):
    rows = [("CC BY 4.0", "A A 9.9"), ("Bajo Turmás; E13", "Aa Aa; A9"), ("ño", "a"), ("", ""), ("x" * 90 + " Y1.", " .9Aa")]
    got = spark.createDataFrame(rows, "v string, want string").select(mask(F.col("v")).alias("m"), "want").collect()
    assert [r.m for r in got] == [r.want for r in got]


def test_metrics_and_changes(spark):
    rows = [(1, "aa")] * 8 + [(1, None)] * 2 + [(2, "aa")] * 4 + [(2, "nan")] * 6 + [(3, "bbbb")] * 10 + [(None, "zz")] * 5 + [(5, "")] * 3
    df = spark.createDataFrame(rows, "load_id int, f string").withColumn("mask", F.lit("x")).withColumn("value", F.lit("y"))
    m = {r.load_id: r for r in load_metrics(mask_table(df, ["f"])).collect()}
    assert sorted(m) == [1, 2, 3, 5]
    assert [(m[k].rows_total, m[k].missing, m[k].novel_rows, m[k].load_before) for k in (1, 2, 3, 5)] == [(10, 2, 8, None), (10, 6, 0, 1), (10, 0, 10, 2), (3, 3, 0, 3)]
    got = {(r.load_id, r.kind) for r in changes(load_metrics(mask_table(df, ["f"]))).collect()}
    assert got == {(2, "missing"), (3, "missing"), (3, "length"), (3, "novel"), (5, "missing")}
    assert (3, "novel") not in {(r.load_id, r.kind) for r in changes(load_metrics(mask_table(df, ["f"])), not_novel=("f",)).collect()}
    assert profile(df.limit(0), ["f"]).count() == 0 and profile(df, ["f"]).count() == 4


def test_divergence_and_violations(spark):
    df = spark.createDataFrame([(1, "ab")] * 999 + [(1, "A1")] + [(2, "12")] * 1000, "load_id int, f string")
    got = {r.load_id: r.mask_divergence for r in mask_divergence(mask_table(df, ["f"])).collect()}
    assert got[1] is None and math.isclose(got[2], 1.0, abs_tol=1e-6)
    assert [tuple(r) for r in mask_violations(mask_table(df, ["f"])).collect()] == [(1, "f", "A9", 1, 1)]
