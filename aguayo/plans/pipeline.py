"""From reviewed and enrichment tables to the harmonised corpus: enrich, adapt, unite, order, validate, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, coalesce_non_empty
from ..operators.checks import Expectations, require_same_schema, validate_corpus
from ..operators.keys import checked_left_join, require_complete_match
from ..operators.mapping import apply_mapping
from ..sources.sinks import write_csv, write_parquet
from ..sources.storage import promote, remove
from .museums import MAPPINGS, BuildInfo, SourceSpec


def enrich(spec: SourceSpec, reviewed: DataFrame, enrichment: DataFrame, check: bool = True, expected_rows: int | None = None) -> DataFrame:
    """The reviewed rows with gaps filled and columns recovered from the enrichment table, and lineage.

    Keys must be unique and non-empty on both sides (``check``). With ``expected_rows`` the number
    of rows and a match for each of them are required. Reviewed columns that the specification
    does not name pass through.
    """
    p = spec.prefix
    joined = checked_left_join(reviewed, enrichment, spec.reviewed_key, spec.enrichment_key, p, list(spec.enrichment_fields), check=check)
    if expected_rows is not None:
        require_complete_match(joined, expected_rows, spec.museum)
    filled = joined.withColumns(
        {c: coalesce_non_empty(c, p + d) for c, d in spec.coalesced.items()}
        | {c: clean(p + d) for c, d in spec.recovered.items()}
        | {"metadata_recovery_source": F.lit(spec.recovery_source), "metadata_recovery_version": F.lit(spec.recovery_version)}
    )
    return filled.drop("_join_key", "_merge_status", *[p + f for f in spec.enrichment_fields])


def adapt(spec: SourceSpec, enriched: DataFrame, info: BuildInfo) -> DataFrame:
    return apply_mapping(enriched, MAPPINGS[spec.museum](info))


def unite(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        require_same_schema(out, x)
        out = out.unionByName(x)
    return out


def build_corpus(sources: list[tuple[SourceSpec, DataFrame, DataFrame]], info: BuildInfo, check: bool = True, order: tuple[str, ...] = ("museum", "source_object_id")) -> DataFrame:
    """The corpus of all sources, ordered; lexical order of strings by code point."""
    return unite([adapt(s, enrich(s, r, e, check), info) for s, r, e in sources]).orderBy(*order)


def write_corpus(corpus: DataFrame, expected: Expectations, parquet: str, csv: str, order: tuple[str, ...] = ("museum", "source_object_id")) -> None:
    """Compute the corpus once, into a staged table; validate what is there, then put it in place and write the CSV, ordered.

    Nothing is kept on executors. A corpus that fails leaves no table.
    """
    spark, staged = corpus.sparkSession, f"{parquet}.unchecked"
    write_parquet(corpus, staged)
    try:
        validate_corpus(spark.read.parquet(staged), expected)
    except BaseException:
        remove(spark, staged)
        raise
    promote(spark, staged, parquet)
    write_csv(spark.read.parquet(parquet).orderBy(*order), csv)
