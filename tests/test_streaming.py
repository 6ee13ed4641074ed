from aguayo.operators.contract import Contract
from aguayo.streaming.gate import broken_rules, cleaned, write_once

CONTRACT = Contract(("id", "museum", "url"), required=("id",), allowed={"museum": ("MET",)}, patterns={"url": "^https?://"})
ROWS = [("1", "MET", "https://x"), (" nan ", "MET", ""), ("2", "XX", "ftp://y"), (None, None, None)]


def test_stream_is_split_and_repeated_batches_replace_themselves(spark, tmp_path):
    spark.createDataFrame(ROWS, "id string, museum string, url string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, museum string, url string").parquet(str(tmp_path / "in"))
    checked = broken_rules(cleaned(stream, ["id"]), CONTRACT)
    write = write_once(str(tmp_path / "ok"), str(tmp_path / "bad"))
    q = checked.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["1"]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted(map(tuple, (r.broken_rules for r in bad.collect()))) == [("allowed museum", "pattern url"), ("required id",), ("required id",)]
    write(broken_rules(spark.createDataFrame(ROWS, "id string, museum string, url string"), CONTRACT), 0)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2  # " nan " is not cleaned here
