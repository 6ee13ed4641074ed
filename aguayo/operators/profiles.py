"""Profiles in long form: coverage, distinct values, frequencies, identifier quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prefix_of, ratio, strip


def profile_columns(df: DataFrame, fields: list[str], label: str, with_available: bool = True, distinct: bool = True) -> DataFrame:
    """museum, field, available, non_empty, total, coverage, unique_non_empty, ordinal; a row per field.

    Values are stripped only. With ``with_available`` an absent field comes out as not available
    with zeros and the total; without it, it raises. One wide aggregate, then one row is turned
    into many; for distinct values the columns are counted in long form after pre-aggregation.
    """
    here = [f for f in fields if f in df.columns]
    if not with_available and len(here) < len(fields):
        raise KeyError(sorted(set(fields) - set(here)))
    n = {f: f"n{i}" for i, f in enumerate(here)}
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(strip(f) != "", 1)).alias(n[f]) for f in here])
    item = lambda i, f: F.struct(
        F.lit(f).alias("field"), F.lit(f in n).alias("available"), (F.col(n[f]) if f in n else F.lit(0)).cast("long").alias("non_empty"), F.lit(i).alias("ordinal")
    )
    out = wide.select(F.lit(label).alias("museum"), "total", F.inline(F.array(*[item(i, f) for i, f in enumerate(fields)])))
    out = out.withColumn("coverage", ratio(F.col("non_empty"), F.col("total")))
    if distinct:
        out = out.join(distinct_counts(df, here), "field", "left").withColumn("unique_non_empty", F.coalesce("unique_non_empty", F.lit(0).cast("long")))
    cols = ["museum", "field", *["available"] * with_available, "non_empty", "total", "coverage", *["unique_non_empty"] * distinct, "ordinal"]
    return out.select(*cols)


def distinct_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, unique_non_empty): distinct stripped values, one grouping for all fields."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), strip(f).alias("v")) for f in fields]))).filter(F.col("v") != "")
    return long.groupBy("field", "v").agg(F.lit(1).alias("one")).groupBy("field").agg(F.count(F.lit(1)).alias("unique_non_empty"))


def coverage_by_group(df: DataFrame, group: str, fields: list[str], everything: str = "ALL") -> DataFrame:
    """group, field, non_empty, total, coverage of all rows and of each group, in one pass.

    The row of all is told by grouping_id, so a group that is NULL stays a group of its own.
    """
    wide = df.rollup(group).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), *[F.count(F.when(strip(f) != "", 1)).alias(f"_n{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("non_empty")) for i, f in enumerate(fields)])
    return wide.select(F.when(F.col("_g") == 1, everything).otherwise(F.col(group)).alias(group), "total", F.inline(rows)).select(group, "field", "non_empty", "total", ratio(F.col("non_empty"), F.col("total")).alias("coverage"))


def group_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value; NULL is no value."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values, missing included; ties by value, NULL first."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(n)


def identifier_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, rows, empty, duplicates (surplus rows among the non-empty) of candidate identifiers."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), strip(F.col(c).cast("string")).alias("v")) for c in cols])))
    per_value = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("v") != ""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_value.groupBy("column_name").agg(total("n").alias("rows"), total(F.when(~full, F.col("n"))).alias("empty"), total(F.when(full, F.col("n") - 1)).alias("duplicates"))


# Tokens by which a column may belong to a category.
CATEGORY_TOKENS = {
    "id": ("id", "object", "accession", "registro"),
    "status": ("estado", "status", "curacion", "revis"),
    "image": ("imagen", "image", "primaryimagesmall", "iiif"),
    "object_url": ("objecturl", "object_url", "url_objeto", "web_url"),
    "title": ("titulo", "title"),
    "description": ("descripcion", "description"),
    "culture": ("cultura", "culture"),
    "period": ("periodo", "period", "date"),
    "material": ("material", "medium"),
    "technique": ("tecnica", "technique"),
}


def candidate_columns(columns: list[str], categories: dict[str, tuple[str, ...]] = CATEGORY_TOKENS) -> dict[str, list[str]]:
    return {c: [x for x in columns if any(t in x.lower().strip() for t in tokens)] for c, tokens in categories.items()}


def find_columns(spark: SparkSession, tables: dict[str, list[str]]) -> DataFrame:
    """(table_name, category, column_name) of all candidate columns by name."""
    rows = [(t, c, x) for t, cols in tables.items() for c, xs in candidate_columns(cols).items() for x in xs]
    return spark.createDataFrame(rows, "table_name string, category string, column_name string")


def first_row_preview(df: DataFrame, order: str, n: int = 160) -> DataFrame:
    """(field, value) of the non-empty fields of the first row by ``order``, cut to ``n`` characters for display."""
    cols = [c for c in df.columns if c != order]
    first = df.orderBy(order).limit(1)
    return first.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), prefix_of(F.col(c).cast("string"), n).alias("value")) for c in cols]))).filter(F.col("value") != "")
