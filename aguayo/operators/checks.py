"""Fail-fast checks. Each raises ValidationError with the name of its rule and counts in the message."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.storage import exists


class ValidationError(ValueError):
    def __init__(self, rule: str, message: str):
        super().__init__(message)
        self.rule = rule


def absent_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str], name: str) -> None:
    missing = absent_columns(df, required)
    if missing:
        raise ValidationError("columns", f"{name}: missing columns {missing}")


def require_same_schema(a: DataFrame, b: DataFrame) -> None:
    """Names and their order; tells the differences and the first place that differs."""
    if a.columns != b.columns:
        x, y = set(a.columns), set(b.columns)
        at = next((i for i, (p, q) in enumerate(zip(a.columns, b.columns)) if p != q), min(len(a.columns), len(b.columns)))
        raise ValidationError("schema", f"only left {sorted(x - y)}, only right {sorted(y - x)}, first difference at {at}")


def require_file(spark: SparkSession, path: str) -> None:
    """Raise FileNotFoundError for a path, local or a URI, that is not there."""
    if not exists(spark, path):
        raise FileNotFoundError(path)


def source_verdicts(sources: Mapping[str, tuple], ) -> list[tuple[str, int | None, int, str]]:
    """(name, rows, expected, verdict) of (reader, expected rows) by name: APROBADO, REVISAR, or the error of that source alone."""
    out = []
    for name, (read, expected) in sources.items():
        try:
            n = read().count()
            out.append((name, n, expected, "APROBADO" if n == expected else "REVISAR"))
        except Exception as e:  # noqa: BLE001 - one bad source must not hide the others
            out.append((name, None, expected, f"ERROR {type(e).__name__}"))
    return out


@dataclass(frozen=True)
class Expectations:
    """What a corpus has to fulfil; checked in the order of the fields."""

    rows: int
    columns: int
    id_column: str = "item_id"
    source_key: tuple[str, str] = ("museum", "source_object_id")
    group: str = "museum"
    group_counts: Mapping[str, int] = field(default_factory=dict)
    complete: tuple[str, ...] = ()
    single_values: Mapping[str, str] = field(default_factory=dict)
    timestamp_column: str = "processing_timestamp"
    timestamp: str = ""


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: for each column the number of rows that are empty after stripping."""
    return df.agg(*[F.count(F.when(strip(c) == "", 1)).alias(c) for c in cols])


def corpus_metrics(df: DataFrame, e: Expectations) -> DataFrame:
    """All counts that validate_corpus needs but group counts, in one row and one pass over the corpus.

    duplicate_ids and duplicate_source_keys are surplus rows, NULL as a value of its own;
    empty_<column>, other_<column> rows that differ from the single value, timestamps distinct
    values. Distinct counts have a map-side part in the same aggregate.
    """
    surplus = lambda *cs: F.count(F.lit(1)) - F.count_distinct(F.struct(*cs))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(strip(c) == "", 1)).alias(f"empty_{c}") for c in e.complete],
        *[F.count(F.when(~F.col(c).eqNullSafe(v), 1)).alias(f"other_{c}") for c, v in e.single_values.items()],
        F.count(F.when(F.col(e.timestamp_column).isNull(), 1)).alias("null_timestamps"),
        F.min(e.timestamp_column).alias("timestamp_min"),
        F.max(e.timestamp_column).alias("timestamp_max"),
        surplus(e.id_column).alias("duplicate_ids"),
        surplus(*e.source_key).alias("duplicate_source_keys"),
        F.lit(len(df.columns)).alias("columns"),
    )


def validate_corpus(df: DataFrame, e: Expectations) -> None:
    """Rows, columns, ids, source keys, group counts, completeness, single values, timestamps: the first failure raises.

    One row of metrics and one of group counts are computed; offenders are left to the caller.
    """
    absent = sorted(({e.id_column, e.timestamp_column, e.group, *e.source_key, *e.complete, *e.single_values}) - set(df.columns))
    if absent:
        n = df.count()
        if n != e.rows:
            raise ValidationError("rows", f"{n} rows instead of {e.rows}")
        if len(df.columns) != e.columns:
            raise ValidationError("columns", f"{len(df.columns)} columns instead of {e.columns}")
        raise ValidationError("absent", f"missing columns {absent}")
    m = corpus_metrics(df, e).first().asDict()
    if m["rows"] != e.rows:
        raise ValidationError("rows", f"{m['rows']} rows instead of {e.rows}")
    if m["columns"] != e.columns:
        raise ValidationError("columns", f"{m['columns']} columns instead of {e.columns}")
    if m["duplicate_ids"]:
        raise ValidationError("id_unique", f"{m['duplicate_ids']} duplicate values of {e.id_column}")
    if m["duplicate_source_keys"]:
        raise ValidationError("source_key_unique", f"{m['duplicate_source_keys']} duplicate values of {e.source_key}")
    counts = {r[0]: r[1] for r in df.groupBy(e.group).count().limit(len(e.group_counts) + 100).collect()}
    if counts != dict(e.group_counts):
        raise ValidationError("group_counts", f"{counts} instead of {dict(e.group_counts)}")
    for c in e.complete:
        if m[f"empty_{c}"]:
            raise ValidationError("complete", f"{m[f'empty_{c}']} empty values of {c}")
    for c, v in e.single_values.items():
        if m[f"other_{c}"]:
            raise ValidationError("single_value", f"{m[f'other_{c}']} values of {c} other than {v}")
    if m["null_timestamps"] or m["timestamp_min"] != m["timestamp_max"]:
        raise ValidationError("single_timestamp", f"more than one value of {e.timestamp_column}")
    if m["timestamp_min"] != e.timestamp:
        raise ValidationError("timestamp", f"{m['timestamp_min']} instead of {e.timestamp}")
