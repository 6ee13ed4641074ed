from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aguayo.functions.text import clean_py
from aguayo.llm.frequency import run_lengths, value_frequencies

ROW = st.tuples(st.sampled_from(["i1", "i2", " i2", "i3", "", None]), st.sampled_from(["a", " a ", "b", "nan", None, "", "A"]), st.sampled_from(["x", "y", None]))


def brute(rows):
    items = {clean_py(r[0]) for r in rows} - {""}
    seen = defaultdict(list)
    for i, *vs in rows:
        for f, v in zip("uv", vs):
            if clean_py(v):
                seen[f, clean_py(v)].append(clean_py(i))
    out = []
    for (f, v), s in seen.items():
        n = len(set(s) - {""})
        out.append((f, v, len(s), n, "rare" if n <= 1 else "common" if n > 0.5 * len(items) else None))
    return sorted(out, key=str)


@settings(max_examples=10, deadline=None)
@given(st.lists(ROW, max_size=12))
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "item string, u string, v string")
    got = value_frequencies(df, ["u", "v"], "item", rare_at_most=1, common_share=0.5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_hot_value_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(6_000).selectExpr("cast(id % 4000 AS string) AS item", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id % 100) END AS u", "id AS record", "'q' AS value_text")
        rows = {r.value_text: r for r in value_frequencies(df, ["u"], "item").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (rows["hot"].occurrences, rows["hot"].records, rows["hot"].mark) == (2000, len({i % 4000 for i in range(0, 6000, 3)}), "common")
    assert sum(r.occurrences for r in rows.values()) == 6_000
    assert value_frequencies(df.limit(0), ["u"], "item").count() == 0


def test_equal_pairs_part_and_count_once(spark):
    rows = [("hot", "v")] * 4_000 + [("", "v")] * 4_000 + [(f"i{k}", f"w{k % 50}") for k in range(1_000)]
    df = spark.createDataFrame(rows, "item string, u string").repartition(8)
    pairs = run_lengths(df, ["u"], "item")
    got = {r.value_text: (r.occurrences, r.records) for r in pairs.collect()}
    assert got["v"] == (8_000, 1) and all(got[f"w{k}"] == (20, 20) for k in range(50))
    tag = df.withColumn("part", F.spark_partition_id()).repartitionByRange(4, "u", "item", "part").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in tag.collect()) < 5_000  # neither the hot record nor the rows without one stay whole
