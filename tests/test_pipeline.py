"""The corpus build on synthetic sources of the published sizes, and each validation rule on its own."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from aguayo.operators.checks import Expectations, ValidationError, corpus_metrics, require_columns, require_same_schema, source_verdicts, validate_corpus
from aguayo.operators.mapping import apply_mapping
from aguayo.plans.museums import CMA, COMPLETE, MAPPINGS, MET, REQUIRED, BuildInfo
from aguayo.plans.pipeline import build_corpus, enrich, write_corpus
from aguayo.sources.sinks import fingerprint

INFO = BuildInfo("2026-01-31T00:00:00Z")
EXPECTED = Expectations(215, 42, group_counts={"MET": 127, "CMA": 88}, complete=COMPLETE, single_values={"dataset_split": "principal", "review_status": "aprobado"}, timestamp=INFO.timestamp)


def source(spark, spec, n, m):
    reviewed = spark.range(n).select(*[F.concat(F.lit(f"{c}-"), "id").alias(c) for c in spec.reviewed_fields])
    enrichment = spark.range(m).select(F.concat(F.lit(f"{spec.reviewed_key}-"), "id").alias(spec.enrichment_key), *[F.concat(F.lit(f"{c}-"), "id").alias(c) for c in spec.enrichment_fields])
    return spec, reviewed, enrichment


@pytest.fixture(scope="module")
def sources(spark):
    return [source(spark, MET, 127, 295), source(spark, CMA, 88, 146)]


@pytest.fixture(scope="module")
def corpus(sources):
    return build_corpus(sources, INFO).cache()


def test_contract_of_the_schema():
    met, cma = list(MAPPINGS["MET"](INFO)), list(MAPPINGS["CMA"](INFO))
    assert met == cma and len(met) == 42 and len(set(met)) == 42
    assert len(COMPLETE) == 22 and len(REQUIRED) == 17 and set(COMPLETE) <= set(met)


def test_build(corpus, sources):
    validate_corpus(corpus, EXPECTED)
    rows = [(r.museum, r.source_object_id) for r in corpus.select("museum", "source_object_id").collect()]
    assert rows == sorted(rows) and len(set(rows)) == 215
    again = build_corpus(sources, INFO)
    assert again.dtypes == corpus.dtypes and fingerprint(again) == fingerprint(corpus)


def test_enrichment_fills_gaps_only(spark):
    spec, r, e = source(spark, MET, 3, 5)
    r = r.withColumn("cultura", F.when(F.col("id_fuente") == "id_fuente-0", " NaN ").when(F.col("id_fuente") == "id_fuente-1", F.lit(None)).otherwise(" x  y ")).withColumn("extra", F.lit(1))
    got = {x.id_fuente: x for x in enrich(spec, r, e, expected_rows=3).collect()}
    assert [got[f"id_fuente-{i}"].cultura for i in range(3)] == ["cultura-0", "cultura-1", "x y"]
    assert got["id_fuente-0"].extra == 1 and got["id_fuente-0"].pais_recuperado == "pais-0"
    with pytest.raises(ValidationError):
        enrich(spec, r.unionByName(r), e)


@pytest.mark.parametrize(
    "rule,change,expect",
    [
        ("rows", lambda c: c.limit(214), {}),
        ("columns", lambda c: c.withColumn("more", F.lit(1)), {}),
        ("absent", lambda c: c.drop("license").withColumn("more", F.lit("")), {}),
        ("id_unique", lambda c: c.withColumn("item_id", F.when(F.col("item_id") == "MET:id_fuente-1", "MET:id_fuente-0").otherwise(F.col("item_id"))), {}),
        ("source_key_unique", lambda c: c.withColumn("source_object_id", F.when(F.col("item_id") == "MET:id_fuente-1", "id_fuente-0").otherwise(F.col("source_object_id"))), {}),
        ("group_counts", lambda c: c, {"group_counts": {"MET": 215}}),
        ("complete", lambda c: c.withColumn("culture", F.when(F.col("item_id") == "MET:id_fuente-1", " \t").otherwise(F.col("culture"))), {}),
        ("single_value", lambda c: c.withColumn("review_status", F.when(F.col("item_id") == "MET:id_fuente-1", "otro").otherwise(F.col("review_status"))), {}),
        ("single_timestamp", lambda c: c.withColumn("processing_timestamp", F.when(F.col("item_id") == "MET:id_fuente-1", "2020").otherwise(F.col("processing_timestamp"))), {}),
        ("timestamp", lambda c: c, {"timestamp": "2020-01-01"}),
    ],
)
def test_each_rule_alone(corpus, rule, change, expect):
    with pytest.raises(ValidationError) as e:
        validate_corpus(change(corpus), replace(EXPECTED, **expect))
    assert e.value.rule == rule


def test_schema_checks(spark, corpus):
    with pytest.raises(ValidationError, match="'zz'"):
        require_columns(corpus, ["zz"], "t")
    with pytest.raises(ValidationError, match="first difference at 0"):
        require_same_schema(corpus, corpus.select(*reversed(corpus.columns)))
    with pytest.raises(ValidationError):
        apply_mapping(spark.range(1), MAPPINGS["MET"](INFO))


def test_sources_are_judged_alone(spark):
    def broken():
        raise FileNotFoundError("x")

    got = source_verdicts({"a": (lambda: spark.range(3), 3), "b": (lambda: spark.range(3), 4), "c": (broken, 1)})
    assert [g[3] for g in got] == ["APROBADO", "REVISAR", "ERROR FileNotFoundError"]


def test_write(spark, corpus, tmp_path):
    write_corpus(corpus, EXPECTED, str(tmp_path / "c.parquet"), str(tmp_path / "c.csv"))
    assert fingerprint(spark.read.parquet(str(tmp_path / "c.parquet"))) == fingerprint(corpus)
    raw = (tmp_path / "c.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfitem_id,museum") and raw.count(b"\n") == 216
    with pytest.raises(ValidationError):
        write_corpus(corpus, replace(EXPECTED, rows=1), str(tmp_path / "d.parquet"), str(tmp_path / "d.csv"))
    assert not (tmp_path / "d.parquet").exists() and not (tmp_path / "d.parquet.unchecked").exists()


def test_metrics_take_one_pass(corpus, sources):
    plan = corpus_metrics(build_corpus(sources, INFO, check=False, order=("item_id",)), EXPECTED)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 4 and "Join Inner" not in plan
    nulls = corpus.limit(3).withColumns({"item_id": F.lit(None).cast("string"), "museum": F.lit("M")})
    m = corpus_metrics(nulls, EXPECTED).first()
    assert (m.rows, m.duplicate_ids, m.duplicate_source_keys) == (3, 2, 0)
