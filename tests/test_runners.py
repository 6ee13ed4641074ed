import subprocess

import pytest

from aguayo.functions.sql import percent, register
from aguayo.operators.checks import Expectations
from aguayo.plans import facade
from aguayo.plans.config import utc_now
from aguayo.plans.museums import CMA, COMPLETE, MET, BuildInfo
from aguayo.plans.runners import describe, run_adapt, run_build, run_coverage, run_enrich, run_join_audit, run_profile
from aguayo.sources.blobs import Pinned, binary_files, blob_at, digest, extract, preflight
from aguayo.sources.csv import csv_strings

from .test_text import CASES


def csv_file(path, names, n, key, key_name):
    path.write_text("﻿" + ",".join(names) + "\n" + "".join(",".join(f"{key_name}-{i}" if c == key else f"{c}-{i}" for c in names) + "\n" for i in range(n)), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    return [
        (s, csv_file(d / f"{s.museum}_r.csv", s.reviewed_fields, n, s.reviewed_key, "k"), csv_file(d / f"{s.museum}_e.csv", [s.enrichment_key, *s.enrichment_fields], m, s.enrichment_key, "k"))
        for s, n, m in ((MET, 5, 9), (CMA, 4, 3))
    ]


def test_stages(spark, inputs, tmp_path):
    info = BuildInfo(utc_now())
    s, r, e = inputs[0]
    enriched = run_enrich(spark, s, r, e, str(tmp_path / "interim/met"), 5)
    assert enriched.count() == 5 and (tmp_path / "interim/met.csv").exists()
    assert len(run_adapt(spark, s, str(tmp_path / "interim/met.parquet"), str(tmp_path / "met_adapted"), info).columns) == 42
    expected = Expectations(9, 42, group_counts={"MET": 5, "CMA": 4}, complete=tuple(c for c in COMPLETE if c != "license"), timestamp=info.timestamp)
    said = run_build(spark, inputs, str(tmp_path / "corpus"), info, expected)
    assert "rows: 9" in said and "columns: 42" in said
    assert facade.build_corpus(spark, inputs, info).count() == 9 and facade.run is run_build
    facade.validate_combined_corpus(spark.read.parquet(str(tmp_path / "corpus.parquet")), expected)
    cov = run_coverage(spark, str(tmp_path / "corpus.parquet"), str(tmp_path / "cov.csv")).collect()
    assert len(cov) == 36 and (cov[0].museum, cov[0].field, cov[0].total) == ("ALL", "title", 9)


def test_reports(spark, inputs, tmp_path):
    said = []
    report, missing = run_join_audit(spark, inputs, str(tmp_path / "audit.csv"), said.append)
    assert said[0].splitlines()[1].split() == ["MET", "reviewed_rows", "5.0"] and said[2] == "CMA, missing keys: k-3"
    assert report.count() == 20 and missing == {"MET": [], "CMA": ["k-3"]}
    assert (tmp_path / "audit.csv").read_text(encoding="utf-8-sig").splitlines()[:2] == ["museum,metric,value", "MET,reviewed_rows,5.0"]
    p = run_profile(spark, [(s.museum, r, [s.reviewed_key, "zz"]) for s, r, _ in inputs], str(tmp_path / "p.csv")).collect()
    assert [(x.museum, x.field, x.available, x.unique_non_empty) for x in p] == [("MET", "id_fuente", True, 5), ("MET", "zz", False, 0), ("CMA", "id_objeto", True, 4), ("CMA", "zz", False, 0)]
    d = describe(csv_strings(spark, inputs[0][1]), "id_fuente", ["decision_revision"], ["url_imagen"])
    assert d["rows"] == 5 and d["coverage"] == {"url_imagen": "100.0%"} and d["first_row"]["cultura"] == "cultura-0" and len(d["frequencies"]["decision_revision"]) == 5


def test_sql_functions(spark):
    assert set(register(spark)) == {"strip_text", "clean_text", "first_non_empty", "item_id"}
    spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(CASES)], "i int, v string").createOrReplaceTempView("cases")
    got = {r.i: (r.c, r.s) for r in spark.sql("SELECT i, clean_text(v) AS c, strip_text(v) AS s FROM cases").collect()}
    assert [got[i] for i in range(len(CASES))] == [(c, s) for _, c, s in CASES]
    assert spark.sql("SELECT first_non_empty('nan', ' x '), item_id('M', ' a  b'), item_id('M', NULL)").first() == ("x", "M:a b", "")
    assert percent(0.1225) == "12.2%"


def test_blobs(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.csv").write_bytes("á\r\n".encode("latin-1"))
    git("add", "a.csv")
    git("-c", "user.name=t", "-c", "user.email=t@example.org", "commit", "-qm", "x")
    assert blob_at(str(tmp_path), "HEAD", "a.csv") == b"\xe1\r\n"
    (dest,) = extract(str(tmp_path), {str(tmp_path / "out/b.csv"): ("HEAD", "a.csv")})
    assert binary_files(spark, dest).first().content == b"\xe1\r\n"
    files = {"ok": Pinned(dest, digest(dest).upper(), 1), "bad": Pinned(dest, "00", 2), "none": Pinned(str(tmp_path / "zz"))}
    assert preflight(files, lambda p: 1) == [("bad", "sha256"), ("bad", "rows"), ("none", "missing")]
    with pytest.raises(subprocess.CalledProcessError):
        blob_at(str(tmp_path), "HEAD", "zz")


def test_sinks_take_uris(spark, inputs, tmp_path):
    info = BuildInfo("2026-01-31T00:00:00Z")
    out = f"file:{tmp_path}/deep/er/met"
    assert run_enrich(spark, inputs[0][0], f"file://{inputs[0][1]}", inputs[0][2], out, 5).count() == 5
    expected = Expectations(9, 42, group_counts={"MET": 5, "CMA": 4}, timestamp=info.timestamp)
    run_build(spark, inputs, f"file:{tmp_path}/corpus", info, expected)
    lines = (tmp_path / "corpus.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(lines) == 10 and [x.split(",")[1] for x in lines[1:]] == ["CMA"] * 4 + ["MET"] * 5
    assert not list(tmp_path.glob("*.parts")) and not list(tmp_path.glob("*.unchecked"))
    with pytest.raises(FileNotFoundError):
        csv_strings(spark, f"file:{tmp_path}/none.csv")
