from aguayo.functions.lineage import FEW_PARTS, checkpointed, spread


def test_checkpoint_keeps_rows_and_cuts_the_plan(spark):
    df = checkpointed(spark.range(100).selectExpr("id", "id % 7 AS g").groupBy("g").count())
    assert sorted(r["count"] for r in df.collect()) == [14] * 5 + [15] * 2
    assert "Range" not in df._jdf.queryExecution().toString()


def test_spread_moves_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(10).coalesce(1), spark.range(0, 1000, 1, FEW_PARTS + 1)
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 10
    assert spread(many).rdd.getNumPartitions() == FEW_PARTS + 1
