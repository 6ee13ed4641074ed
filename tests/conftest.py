from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Run a query and its SQL on the same tables: equal columns and equal rows in any order."""
    import duckdb

    db = duckdb.connect()
    for p in Path(TESTDATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(f, sql):
        a = f(spark, TESTDATA)
        cols = sorted(a.columns)
        left = a.select(*cols).collect()
        cur = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})")
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(map(key, left)) == sorted(map(key, cur.fetchall()))

    return check
