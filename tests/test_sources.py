import csv as pycsv

import pytest

from aguayo.operators.contract import Contract, violations
from aguayo.operators.profiles import candidate_columns, coverage_by_group, first_row_preview, identifier_quality, profile_columns, top_values
from aguayo.plans.config import dataset_version, load_config, processing_timestamp
from aguayo.sources.csv import csv_strings, csv_with_fallback
from aguayo.sources.sinks import as_table, summary, write_csv


def test_csv_scan(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿a,b,c\r\n1,"x ""y"", z",NA\r\n\r\n,"",null\r\n"l1\nl2",é,\r\n7\r\n'.encode())
    rows = [tuple(r) for r in csv_strings(spark, str(p)).collect()]
    assert rows == [("1", 'x "y", z', "NA"), ("", "", "null"), ("l1\nl2", "é", ""), ("7", "", "")]
    with pytest.raises(FileNotFoundError):
        csv_strings(spark, str(tmp_path / "none.csv"))
    (tmp_path / "long.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        csv_strings(spark, str(tmp_path / "long.csv")).collect()


def test_csv_fallback(spark, tmp_path):
    for name, data in {"comma": "a,b\né,1\n".encode(), "latin": "a,b\né,1\n".encode("latin-1"), "semi": "a;b\né;1\n".encode(), "latin_semi": "a;b\né;1\n".encode("latin-1")}.items():
        p = tmp_path / f"{name}.csv"
        p.write_bytes(data)
        assert [tuple(r) for r in csv_with_fallback(spark, str(p)).collect()] == [("é", "1")], name
    (tmp_path / "one.csv").write_text("a\n1\n")
    with pytest.raises(RuntimeError, match="one column"):
        csv_with_fallback(spark, str(tmp_path / "one.csv"))


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", "", True, 0.5), (' "q", ', "l1\nl2", False, 1.0), (None, "é", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c boolean, d double").coalesce(1)
    write_csv(df, str(tmp_path / "o.csv"))
    with open(tmp_path / "o.csv", encoding="utf-8-sig", newline="") as f:
        assert list(pycsv.reader(f)) == [["a", "b", "c", "d"], ["a", "", "True", "0.5"], [' "q", ', "l1\nl2", "False", "1.0"], ["", "é", "", ""]]
    write_csv(df.limit(0), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_bytes().strip() == b"\xef\xbb\xbfa,b,c,d"
    assert "rows: 3" in summary(df, "b", "t")
    many = spark.range(1000).selectExpr("concat('g', id % 150) AS g", "'x\ny' AS `a,\"b`")
    said = summary(many, "g", "t")
    assert "rows: 1000" in said and "50 groups not shown" in said
    assert as_table(many, 2).endswith("more rows not shown") and as_table(df).splitlines()[0].split() == ["a", "b", "c", "d"]
    write_csv(many.repartition(5), f"file:{tmp_path}/m.csv")
    with open(tmp_path / "m.csv", encoding="utf-8-sig", newline="") as f:
        rows = list(pycsv.reader(f))
    assert rows[0] == ["g", 'a,"b'] and len(rows) == 1001 and {r[1] for r in rows[1:]} == {"x\ny"}


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("﻿dataset:\n  version: '1.0'\nbuild:\n  processing_timestamp: '2026-07-15T09:44:36Z'\n", encoding="utf-8")
    c = load_config(str(p))
    assert processing_timestamp(c) == "2026-07-15T09:44:36Z" and dataset_version(c) == "1.0"
    for bad in ("[1]", "dataset: {}", "dataset: {}\nbuild: 3"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            load_config(str(p))
    for bad in ({}, {"processing_timestamp": "soon"}):
        with pytest.raises(ValueError):
            processing_timestamp({"build": bad})
    with pytest.raises(ValueError):
        dataset_version({"dataset": {}})


def test_contract(spark):
    c = Contract.from_dict({"fields": [{"name": "id", "required": True}, {"name": "m", "allowed_values": ["A"]}, {"name": "u", "format": "uri"}], "primary_key": "id"})
    df = spark.createDataFrame([("1", "A", "https://x"), ("1", "B", "ftp://x"), (None, "", "")], "id string, m string, u string")
    assert {(r.rule, r.field): r.violations for r in violations(df, c).collect()} == {("required", "id"): 1, ("allowed", "m"): 1, ("pattern", "u"): 1, ("unique", "id"): 1}
    with pytest.raises(ValueError):
        Contract.from_dict({"fields": [{"name": "a"}, {"name": "a"}]})


def test_profiles(spark):
    df = spark.createDataFrame([("g", "x"), ("g", " x "), (None, None), ("h", "")], "g string, v string")
    p = {r.field: tuple(r) for r in profile_columns(df, ["v", "zz"], "L").collect()}
    assert p["v"] == ("L", "v", True, 2, 4, 0.5, 1, 0) and p["zz"] == ("L", "zz", False, 0, 4, 0.0, 0, 1)
    with pytest.raises(KeyError):
        profile_columns(df, ["zz"], "L", with_available=False)
    assert {r.g: (r.non_empty, r.total) for r in coverage_by_group(df, "g", ["v"]).collect()} == {"ALL": (2, 4), "g": (2, 2), "h": (0, 1), None: (0, 1)}
    assert [tuple(r) for r in top_values(df, "g", 2).collect()] == [("g", 2), (None, 1)]
    assert [tuple(r) for r in identifier_quality(df, ["v"]).collect()] == [("v", 4, 2, 1)]
    assert [tuple(r) for r in first_row_preview(spark.createDataFrame([(2, "b"), (1, " a" * 200)], "i int, v string"), "i", 5).collect()] == [("v", "a a a")]
    assert candidate_columns(["Titulo_Original ", "url_imagen", "zz"])["title"] == ["Titulo_Original "]
    none = profile_columns(df.limit(0), ["v"], "L").first()
    assert (none.total, none.coverage) == (0, 0.0)


def test_summary_counts_all_groups(spark):
    said = summary(spark.range(150).selectExpr("CAST(id AS string) AS g"), "g", "t")
    assert "rows: 150\n" in said and "50 groups not shown" in said
