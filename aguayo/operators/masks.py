"""Column quality between loads: masks of characters, rare patterns, missing rates and novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import checkpointed
from ..functions.text import clean, ratio

LONG_TEXT = 80  # characters from which a value is described by the classes it holds, not by their order


def mask(c: Column) -> Column:
    """Class mask of a cleaned value: runs of lower case (and caseless) letters a, capitals A, numbers 9.

    Other characters stand for themselves. Longer texts keep each class once, in order of code
    points, so that prose falls into few patterns.
    """
    m = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), r"[\p{Lu}\p{Lt}]+", "A"), r"\p{N}+", "9")
    return F.when(F.length(c) <= LONG_TEXT, m).otherwise(F.array_join(F.array_sort(F.array_distinct(F.split(m, ""))), ""))


def value_groups(df: DataFrame, fields: list[str], load: str = "load_id") -> DataFrame:
    """The base of all reports: rows per load, field, mask and value, with lengths, in one shuffle.

    ``v`` is the value, or the MD5 digest of a longer one. A missing value has the mask ''.
    """
    long = df.filter(F.col(load).isNotNull()).select(F.col(load).cast("int").alias("load_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), clean(f).alias("value")) for f in fields])))
    return (
        long.select("load_id", "field_name", mask(F.col("value")).alias("mask"), F.when(F.length("value") <= 40, F.col("value")).otherwise(F.md5("value")).alias("v"), F.length("value").cast("long").alias("chars"))
        .groupBy("field_name", "v", "mask", "load_id", "chars")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mask_table(df: DataFrame, fields: list[str], load: str = "load_id", keep: bool = False) -> DataFrame:
    """Rows, values, novelty and lengths per field, mask and load: what all reports are made of.

    novel are the rows whose value stands in no earlier load. It is far smaller than the input;
    ``keep`` writes it once to the checkpoint folder for reports that need it more than once.
    """
    g = value_groups(df, fields, load)
    g = g.withColumn("first_load", F.min("load_id").over(W.partitionBy("field_name", "v")))
    out = g.groupBy("field_name", "mask", "load_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("first_load") == F.col("load_id"), F.col("n")).otherwise(0)).alias("novel"),
        F.count(F.lit(1)).alias("values"),
        F.min("chars").alias("chars_min"),
        F.max("chars").alias("chars_max"),
        F.sum(F.col("chars") * F.col("n")).alias("chars_sum"),
    )
    return checkpointed(out) if keep else out


def _field_masks(masks: DataFrame) -> DataFrame:
    """(field_name, mask, mask_n, field_n) over all loads, missing values left out."""
    full = masks.filter(F.col("mask") != "")
    total = full.groupBy("field_name").agg(F.sum("n").alias("field_n"))
    return full.groupBy("field_name", "mask").agg(F.sum("n").alias("mask_n")).join(total, "field_name")


def load_metrics(masks: DataFrame, dominant_share: float = 0.01, rare_share: float = 0.001) -> DataFrame:
    """A row per load and field of a mask_table with the figures of the load and of the one before.

    rows_total, missing, distinct_values, chars_min, chars_max, chars_sum, novel_rows (value in no
    earlier load), dominant_masks, violations (rows whose mask has less than ``rare_share`` of the
    field's values), and load_before, rows_before, missing_before, present_before,
    chars_sum_before. An empty table gives no rows; a load with only missing values has NULL
    lengths.
    """
    empty = F.col("mask") == ""
    m = masks.join(_field_masks(masks), ["field_name", "mask"], "left").withColumn("share", F.col("mask_n") / F.col("field_n"))
    total = lambda c: F.coalesce(F.sum(F.when(~empty, c)), F.lit(0))
    per_load = m.groupBy("field_name", "load_id").agg(
        F.sum("n").alias("rows_total"),
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("missing"),
        total(F.col("values")).alias("distinct_values"),
        F.min(F.when(~empty, F.col("chars_min"))).alias("chars_min"),
        F.max(F.when(~empty, F.col("chars_max"))).alias("chars_max"),
        total(F.col("chars_sum")).alias("chars_sum"),
        total(F.col("novel")).alias("novel_rows"),
        F.count(F.when(~empty & (F.col("share") >= dominant_share), 1)).alias("dominant_masks"),
        F.coalesce(F.sum(F.when(~empty & (F.col("share") < rare_share), F.col("n"))), F.lit(0)).alias("violations"),
    )
    order = W.partitionBy("field_name").orderBy("load_id")  # a row per load
    before = {"load_before": "load_id", "rows_before": "rows_total", "missing_before": "missing", "chars_sum_before": "chars_sum"}
    per_load = per_load.withColumns({a: F.lag(b).over(order) for a, b in before.items()})
    return per_load.withColumn("present_before", F.col("rows_before") - F.col("missing_before"))


def mask_divergence(masks: DataFrame) -> DataFrame:
    """(field_name, load_id, mask_divergence): Jensen-Shannon divergence (base 2) of a load's masks against the load before.

    Masks of a load and of the next one meet by grouping, no join of loads: every mask counts for
    its own load and, as ``q``, for the load after it. Loads without values give no row, the first
    one NULL.
    """
    by_mask = masks.filter(F.col("mask") != "").select("field_name", "load_id", "mask", "n")
    totals = by_mask.groupBy("field_name", "load_id").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("next_load", F.lead("load_id").over(W.partitionBy("field_name").orderBy("load_id")))
    share = by_mask.join(totals, ["field_name", "load_id"]).withColumn("share", F.col("n") / F.col("total"))
    zero = F.col("share") * 0
    pairs = share.select("field_name", "mask", F.inline(F.array(F.struct(F.col("load_id").alias("at"), F.col("share").alias("p"), zero.alias("q")), F.struct(F.col("next_load").alias("at"), zero.alias("p"), F.col("share").alias("q"))))).filter("at is not null")
    met = pairs.groupBy("field_name", "at", "mask").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    h = lambda x: F.when(x > 0, x * F.log2(2 * x / (F.col("p") + F.col("q")))).otherwise(0.0)
    firsts = F.sum("q") > 0
    return met.groupBy("field_name", F.col("at").alias("load_id")).agg(F.when(firsts, F.round(F.sum(0.5 * h(F.col("p")) + 0.5 * h(F.col("q"))), 9)).alias("mask_divergence"))


def mask_violations(masks: DataFrame, rare_share: float = 0.001) -> DataFrame:
    """Rows per load, field and rare mask (less than ``rare_share`` of the field's values)."""
    rare = _field_masks(masks).filter(F.col("mask_n") < rare_share * F.col("field_n"))
    return masks.join(rare.select("field_name", "mask", "mask_n"), ["field_name", "mask"]).select("load_id", "field_name", "mask", "n", "mask_n")


def changes(metrics: DataFrame, missing_step: float = 0.15, length_factor: float = 1.4, novel_share: float = 0.25, not_novel: tuple[str, ...] = ()) -> DataFrame:
    """(load_id, field_name, kind) of the changes against the load before: missing, length, novel.

    Shares are compared as cross products of counts, so no rounding decides. A load without values
    on either side has no length change; the first load has no changes.
    """
    present = F.col("rows_total") - F.col("missing")
    a, b = F.col("missing") / F.col("rows_total"), F.col("missing_before") / F.col("rows_before")
    mean, mean_before = F.col("chars_sum") / F.nullif(present, F.lit(0)), F.col("chars_sum_before") / F.nullif(F.col("present_before"), F.lit(0))
    kinds = F.array(
        F.when(F.abs(a - b) >= missing_step, "missing"),
        F.when((mean >= length_factor * mean_before) | (mean_before >= length_factor * mean), "length"),
        F.when((present > 0) & (F.col("novel_rows") >= novel_share * present) & ~F.col("field_name").isin(*not_novel) if not_novel else (present > 0) & (F.col("novel_rows") >= novel_share * present), "novel"),
    )
    return metrics.filter("load_before is not null").select("load_id", "field_name", F.explode(F.array_compact(kinds)).alias("kind"))


def profile(df: DataFrame, fields: list[str], load: str = "load_id") -> DataFrame:
    """The report: load_metrics with rates, the range of values and the mask divergence."""
    masks = mask_table(df, fields, load, keep=True)
    ranges = (
        df.filter(F.col(load).isNotNull())
        .select(F.col(load).cast("int").alias("load_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), clean(f).alias("value")) for f in fields])))
        .filter(F.col("value") != "")
        .groupBy("field_name", "load_id")
        .agg(F.min("value").alias("value_min"), F.max("value").alias("value_max"))
    )
    return (
        load_metrics(masks)
        .join(ranges, ["field_name", "load_id"], "left")
        .join(mask_divergence(masks), ["field_name", "load_id"], "left")
        .select(
            "load_id", "field_name", "rows_total", "missing", ratio(F.col("missing"), F.col("rows_total")).alias("missing_rate"), "distinct_values",
            "chars_min", "chars_max", "chars_sum", "value_min", "value_max", "novel_rows", "dominant_masks", "violations", "mask_divergence",
        )
    )
