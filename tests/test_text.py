import pytest
from pyspark.sql import functions as F

from aguayo.functions import text

SPACES = [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CASES = [
    (None, "", ""), ("", "", ""), ("  \t 　", "", ""), ("nan", "", "nan"), (" NaN ", "", "NaN"), ("NULL", "", "NULL"), ("NONE ", "", "NONE"), ("nullx", "nullx", "nullx"),
    ("n an", "n an", "n an"), ("N/A", "N/A", "N/A"), (" a\t\n b ", "a b", "a\t\n b"), ("x  y　", "x y", "x  y"), ("\x1cz\x1f", "z", "z"),
    ("a​b", "a​b", "a​b"), ("﻿q", "﻿q", "﻿q"), ("é  ñ", "é ñ", "é  ñ"), ("ñ", "ñ", "ñ"), ("a\n", "a", "a"),
]


def test_clean_and_strip(spark):
    rows = [(i, v) for i, (v, _, _) in enumerate(CASES)] + [(100 + i, f"{chr(c)}a{chr(c)}b{chr(c)}") for i, c in enumerate(SPACES)]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, v string").select("i", text.clean("v").alias("c"), text.strip("v").alias("s")).collect()}
    for i, (v, c, s) in enumerate(CASES):
        assert (got[i].c, got[i].s) == (c, s), repr(v)
        assert text.clean_py(v) == c
    for i, c in enumerate(SPACES):
        assert got[100 + i].c == "a b", hex(c)
    assert len(SPACES) == 29


def test_first_non_empty_and_item_id(spark):
    df = spark.createDataFrame([("nan", " x ", "y"), (None, None, None), ("a", "b", "c")], "a string, b string, c string")
    assert [r[0] for r in df.select(text.first_non_empty("a", "b", "c")).collect()] == ["x", "", "a"]
    assert [r[0] for r in df.select(text.item_id("M", "a", "blank")).collect()] == ["", "", "M:a"]
    with pytest.raises(Exception, match="empty source id"):
        df.select(text.item_id("M", "a")).collect()


def test_ratio_and_timestamps(spark):
    df = spark.createDataFrame([("2026-07-15T09:44:36Z",), ("2026-07-15",), ("2026",), ("x",), (None,), ("2026-13-01",)], "t string")
    assert [bool(r[0]) for r in df.select(F.coalesce(text.iso_timestamp_valid("t"), F.lit(False))).collect()] == [True, True, False, False, False, False]
    assert spark.range(1).select(text.ratio(F.lit(1), F.lit(0)), text.ratio(F.lit(1), F.lit(4))).first() == (0.0, 0.25)
