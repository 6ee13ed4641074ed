from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from aguayo.functions.text import clean_py
from aguayo.operators.orphans import find_orphans, orphan_counts, orphan_times, tagged_keys

DAY0 = datetime(2025, 1, 30, 12)
TIME = st.integers(0, 12).map(lambda h: DAY0 + timedelta(hours=9 * h))
KEY = st.sampled_from(["a", " a", "b", "c", "", None, "nan"])
CHILD, PARENT = "row_id long, ref string, loaded_at timestamp_ntz", "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def brute(children, parents):
    out = []
    for i, k, t in children:
        k = clean_py(k)
        own = [p for p in parents if clean_py(p[0]) == k]
        if not k or any(p[1] <= t and (p[2] is None or p[2] > t) for p in own):
            continue
        kind = "missing" if not own else "deleted" if any(p[1] <= t for p in own) else "late"
        out.append(("c", i, t.strftime("%Y-%m"), kind))
    return sorted(out)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(KEY, TIME), max_size=8), st.lists(st.tuples(KEY, TIME, st.one_of(st.none(), TIME)), max_size=8))
def test_against_brute_force(spark, c, p):
    c = [(i, *x) for i, x in enumerate(c)]
    got = find_orphans([("c", spark.createDataFrame(c, CHILD), "ref", "p", spark.createDataFrame(p, PARENT), "id")])
    assert sorted(map(tuple, got.collect())) == brute(c, p)


def test_missing_times_and_hot_key(spark):
    c = spark.createDataFrame([(i, "hot", DAY0 + timedelta(hours=i)) for i in range(400)] + [(1000, "x", None), (1001, "y", None)], CHILD)
    p = spark.createDataFrame([("hot", DAY0 + timedelta(hours=10), DAY0 + timedelta(hours=390))] * 50 + [("x", None, None)], PARENT)
    o = find_orphans([("c", c, "ref", "p", p, "id")])
    got = {r.row_id: (r.period, r.kind) for r in o.collect()}
    assert sum(k == "late" for _, k in got.values()) == 11 and sum(k == "deleted" for _, k in got.values()) == 10
    assert got[1000] == (None, "late") and got[1001] == (None, "missing")
    assert orphan_counts(o).groupBy().sum("n").first()[0] == len(got)
    assert find_orphans([("c", c.limit(0), "ref", "p", p.limit(0), "id")]).count() == 0


def test_a_bulk_load_of_one_key_is_split(spark):
    n = 60_000
    c = spark.range(n).selectExpr("id AS row_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS ref", "timestamp_ntz'2025-03-01 08:00:00' AS loaded_at")
    p = spark.createDataFrame([("hot", DAY0, DAY0 + timedelta(hours=1)), ("k1", DAY0, None)], PARENT)
    times = orphan_times(tagged_keys([("c", c, "ref", "p", p, "id")]))
    assert times.filter("key = 'hot'").count() == 1  # 20,000 rows are one before any window sees them
    skew = "spark.sql.adaptive.skewJoin.skewedPartition"
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", f"{skew}ThresholdInBytes", f"{skew}Factor", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for k, v in zip(old, ("-1", "20k", "1.5", "20k")):  # four partitions only, so the hot one is not five times the median
        spark.conf.set(k, v)
    try:
        o = find_orphans([("c", c.repartition(8), "ref", "p", p, "id")])
        assert o.count() == n - 1 and o.filter("kind = 'deleted'").count() == n // 3
        o = find_orphans([("c", c.repartition(8), "ref", "p", p, "id")])
        o.collect()
        assert "skewed" in o._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
