"""Names by which older callers build, check and write the combined corpus; all lead to the same pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.checks import Expectations
from ..operators.checks import validate_corpus as validate_combined_corpus
from ..sources.csv import csv_strings
from . import pipeline
from .museums import BuildInfo, SourceSpec
from .runners import run_build as run

__all__ = ["Expectations", "build_corpus", "run", "validate_combined_corpus"]


def build_corpus(spark: SparkSession, inputs: list[tuple[SourceSpec, str, str]], info: BuildInfo) -> DataFrame:
    """The corpus straight from the source files (specification, reviewed, enrichment), never from tables in between."""
    return pipeline.build_corpus([(s, csv_strings(spark, r), csv_strings(spark, e)) for s, r, e in inputs], info)
