"""Stages as calls with paths: each reads its inputs, writes Parquet and CSV, and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import percent
from ..functions.text import strip
from ..operators.checks import Expectations
from ..operators.keys import first_missing_keys, join_audit
from ..operators.profiles import candidate_columns, coverage_by_group, first_row_preview, profile_columns, top_values
from ..sources.csv import csv_strings
from ..sources.sinks import as_table, summary, write_csv, write_parquet
from .museums import COVERED, BuildInfo, SourceSpec
from .pipeline import adapt, build_corpus, enrich, write_corpus


def _both(df: DataFrame, out: str) -> DataFrame:
    """<out>.parquet and <out>.csv; returns what was written."""
    write_parquet(df, f"{out}.parquet")
    written = df.sparkSession.read.parquet(f"{out}.parquet")
    write_csv(written, f"{out}.csv")
    return written


def _reported(report: DataFrame, out: str, say: Callable[[str], None]) -> DataFrame:
    """The report as a CSV and as a printed table."""
    write_csv(report, out)
    say(as_table(report))
    return report


def run_enrich(spark: SparkSession, spec: SourceSpec, reviewed: str, enrichment: str, out: str, expected_rows: int | None = None) -> DataFrame:
    return _both(enrich(spec, csv_strings(spark, reviewed), csv_strings(spark, enrichment), expected_rows=expected_rows), out)


def run_adapt(spark: SparkSession, spec: SourceSpec, enriched: str, out: str, info: BuildInfo) -> DataFrame:
    return _both(adapt(spec, spark.read.parquet(enriched), info), out)


def run_build(spark: SparkSession, inputs: list[tuple[SourceSpec, str, str]], out: str, info: BuildInfo, expected: Expectations) -> str:
    """Build from the sources, validate, write, and return the summary for the console."""
    corpus = build_corpus([(s, csv_strings(spark, r), csv_strings(spark, e)) for s, r, e in inputs], info)
    write_corpus(corpus, expected, f"{out}.parquet", f"{out}.csv")
    return summary(spark.read.parquet(f"{out}.parquet"), expected.group, info.timestamp) + f"\nwritten: {out}.parquet, {out}.csv"


def run_join_audit(spark: SparkSession, inputs: list[tuple[SourceSpec, str, str]], out: str, say: Callable[[str], None] = print) -> tuple[DataFrame, dict[str, list[str]]]:
    """The audit of all sources as a CSV and a printed table, and the first 25 missing keys of each."""
    report, missing = None, {}
    for s, r, e in inputs:
        left, right = csv_strings(spark, r), csv_strings(spark, e)
        part = join_audit(s.museum, left, right, s.reviewed_key, s.enrichment_key).withColumn("source", F.lit(len(missing)))
        report = part if report is None else report.unionByName(part)
        missing[s.museum] = [x.key for x in first_missing_keys(left, right, s.reviewed_key, s.enrichment_key).collect()]
    report = _reported(report.orderBy("source", "ordinal").select("museum", "metric", "value"), out, say)
    for museum, keys in missing.items():
        say(f"{museum}, missing keys: {', '.join(keys) or 'none'}")
    return report, missing


def run_profile(spark: SparkSession, inputs: list[tuple[str, str, list[str]]], out: str, say: Callable[[str], None] = print) -> DataFrame:
    """(museum, CSV, fields) of each source; a row per field, in the order given."""
    report = None
    for i, (museum, path, fields) in enumerate(inputs):
        part = profile_columns(csv_strings(spark, path), fields, museum).withColumn("source", F.lit(i))
        report = part if report is None else report.unionByName(part)
    return _reported(report.orderBy("source", "ordinal").drop("source", "ordinal"), out, say)


def run_coverage(spark: SparkSession, corpus: str, out: str, fields: tuple[str, ...] = COVERED, groups: tuple[str, ...] = ("ALL", "MET", "CMA"), say: Callable[[str], None] = print) -> DataFrame:
    """Coverage of the corpus by group, groups and fields in the order given, other groups behind."""
    place = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0))
    df = coverage_by_group(spark.read.parquet(corpus), "museum", list(fields))
    df = df.orderBy(place("museum", groups) == 0, place("museum", groups), "museum", place("field", fields))
    return _reported(df, out, say)


def describe(df: DataFrame, order: str, status: list[str] = (), image: list[str] = ()) -> dict:
    """Structure of a source for the console: size, names, columns by category, first row, frequencies, coverage."""
    n = df.count()
    shares = df.agg(*[F.count(F.when(strip(c) != "", 1)).alias(c) for c in image]).first().asDict() if image else {}
    return {
        "rows": n,
        "columns": list(df.columns),
        "candidates": candidate_columns(df.columns),
        "first_row": {r.field: r.value for r in first_row_preview(df, order).collect()},
        "frequencies": {c: [tuple(r) for r in top_values(df, c, 15).collect()] for c in status},
        "coverage": {c: percent(v / n) if n else percent(0.0) for c, v in shares.items()},
    }
