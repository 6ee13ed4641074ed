"""Keys: uniqueness, checked one-to-one joins, key sets, join audits and latest deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, ratio, strip
from .checks import ValidationError

Normalizer = Callable[[Column | str], Column]


def latest_by_key(df: DataFrame, key: str, order: list[str], normalizer: Normalizer = clean) -> DataFrame:
    """The last delivery of every non-missing key by ``order`` (ties: the later column decides).

    An aggregate with a map-side part instead of a window, so a key with very many deliveries
    never gathers in one task.
    """
    cols = df.columns
    packed = df.select(normalizer(key).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.struct(*order).alias("_o")).filter(F.col("_k") != "")
    return packed.groupBy("_k").agg(F.max_by("_row", "_o").alias("_row")).select("_row.*")


def unique_key_metrics(df: DataFrame, key: str, normalizer: Normalizer = clean) -> DataFrame:
    """One row: rows, empty_keys, duplicate_keys (surplus rows among the non-empty)."""
    per_key = df.select(normalizer(key).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("k") != ""
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).alias("empty_keys"),
        F.coalesce(F.sum(F.when(full, F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"),
    )


def require_unique_key(df: DataFrame, key: str, name: str, normalizer: Normalizer = clean) -> None:
    """Raise for empty keys, then for duplicates, with their number."""
    m = unique_key_metrics(df, key, normalizer).first()
    if m.empty_keys:
        raise ValidationError("empty_key", f"{name}: {m.empty_keys} empty keys in {key}")
    if m.duplicate_keys:
        raise ValidationError("duplicate_key", f"{name}: {m.duplicate_keys} duplicate keys in {key}")


def checked_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: str, fields: list[str], normalizer: Normalizer = clean, check: bool = True) -> DataFrame:
    """Left join on the normalised key, one to one, with ``_join_key`` and ``_merge_status``.

    The right side brings ``fields`` under ``prefix``; columns of the left side keep their names,
    also those that begin with the prefix, unless both clash, which raises. ``_merge_status`` is
    ``both`` or ``left_only``. With ``check`` a duplicate key on either side raises first.
    """
    taken = {prefix + f for f in fields} & set(left.columns)
    if taken:
        raise ValidationError("column_clash", f"columns on both sides: {sorted(taken)}")
    if check:
        require_unique_key(left, left_key, "left", normalizer)
        require_unique_key(right, right_key, "right", normalizer)
    r = right.select(normalizer(right_key).alias("_join_key"), *[F.col(f).alias(prefix + f) for f in fields], F.lit(True).alias("_met"))
    joined = left.withColumn("_join_key", normalizer(left_key)).join(r, "_join_key", "left")
    return joined.withColumn("_merge_status", F.when(F.col("_met"), "both").otherwise("left_only")).drop("_met")


def require_complete_match(joined: DataFrame, expected_rows: int, name: str) -> None:
    """Raise for another number of rows, then for rows without a match."""
    m = complete_match_metrics(joined).first()
    if m.rows != expected_rows:
        raise ValidationError("row_count", f"{name}: {m.rows} rows instead of {expected_rows}")
    if m.unmatched:
        raise ValidationError("unmatched", f"{name}: {m.unmatched} rows without a match")


def complete_match_metrics(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_merge_status") != "both", 1)).alias("unmatched"))


def _keys(df: DataFrame, key: str, normalizer: Normalizer) -> DataFrame:
    return df.select(normalizer(key).alias("key")).filter(F.col("key") != "").distinct()


def matched_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, normalizer: Normalizer = strip) -> DataFrame:
    return _keys(left, left_key, normalizer).join(_keys(right, right_key, normalizer), "key", "left_semi")


def missing_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, normalizer: Normalizer = strip) -> DataFrame:
    """Distinct non-empty keys of the left side that the right side lacks."""
    return _keys(left, left_key, normalizer).join(_keys(right, right_key, normalizer), "key", "left_anti")


def first_missing_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int = 25, normalizer: Normalizer = strip) -> DataFrame:
    """The first ``n`` missing keys in code point order (a listing for the console)."""
    return missing_keys(left, right, left_key, right_key, normalizer).orderBy("key").limit(n)


AUDIT_METRICS = (
    "reviewed_rows", "enrichment_rows", "reviewed_empty_keys", "enrichment_empty_keys", "reviewed_duplicate_keys", "enrichment_duplicate_keys",
    "matched_reviewed_keys", "missing_reviewed_keys", "match_rate", "unused_enrichment_keys",
)


def join_audit(label: str, left: DataFrame, right: DataFrame, left_key: str, right_key: str, normalizer: Normalizer = strip) -> DataFrame:
    """Ten metrics of a planned join in long form: museum, metric, value (double), ordinal.

    The match rate divides distinct matched keys by all left rows. Both sides are reduced to one
    row per key first; keys then meet by grouping their union.
    """
    side = lambda df, key, s: df.select(normalizer(key).alias("k"), F.lit(s).alias("s")).groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"))
    both = side(left, left_key, 0).unionByName(side(right, right_key, 1))
    per_key = both.groupBy("k").agg(*[F.coalesce(F.sum(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).alias(a) for s, a in ((0, "l"), (1, "r"))])
    full, l, r = F.col("k") != "", F.col("l"), F.col("r")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    m = per_key.agg(
        total(l).alias("m0"), total(r).alias("m1"), total(F.when(~full, l)).alias("m2"), total(F.when(~full, r)).alias("m3"),
        total(F.when(full & (l > 0), l - 1)).alias("m4"), total(F.when(full & (r > 0), r - 1)).alias("m5"),
        F.count(F.when(full & (l > 0) & (r > 0), 1)).alias("m6"), F.count(F.when(full & (l > 0) & (r == 0), 1)).alias("m7"),
        F.count(F.when(full & (l == 0) & (r > 0), 1)).alias("m9"),
    ).withColumn("m8", ratio(F.col("m6"), F.col("m0")))
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").cast("double").alias("value"), F.lit(i).alias("ordinal")) for i, name in enumerate(AUDIT_METRICS)])
    return m.select(F.lit(label).alias("museum"), F.inline(rows))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys occur more than once, NULL equal to NULL; duplicates are found by count, not by gathering."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_d{i}") for i, k in enumerate(keys)])
    on = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(twice[f"_d{i}"])
        on = c if on is None else on & c
    return df.join(twice, on, "left_semi")
