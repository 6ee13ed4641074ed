"""References to records that do not exist, by one long form of tagged parent and child keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clean

NEVER = "9999-12-31 00:00:00"  # the end of what was never deleted


def tagged_keys(links: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Long form of all links (child table, child, child key, parent table, parent, parent key).

    Columns: src_table, key, at, ends (until when a parent lives), parent (1 or 0).
    """
    out = None
    for src, child, ck, _, parent, pk in links:
        ends = F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.lit(NEVER).cast("timestamp_ntz"))
        p = parent.select(F.lit(src).alias("src_table"), clean(pk).alias("key"), _time().alias("at"), ends.alias("ends"), F.lit(1).alias("parent"))
        c = child.select(F.lit(src).alias("src_table"), clean(ck).alias("key"), _time().alias("at"), F.lit(None).cast("timestamp_ntz").alias("ends"), F.lit(0).alias("parent"))
        both = p.unionByName(c)
        out = both if out is None else out.unionByName(both)
    return out.filter(F.col("key") != "")


def _time() -> Column:
    return F.col("loaded_at").cast("timestamp_ntz")


def orphan_times(long: DataFrame) -> DataFrame:
    """(src_table, key, at, kind) of the times at which references to a key find no living parent.

    The long form is grouped by link, key and time, with a map-side part: all rows of one key
    and load are one row, however many they are. Groups of a key that lack the parent flag are
    ``missing``. Of the others, a window over the seconds of a key carries how far earlier parents
    live, another one settles the order inside a second. So no window holds more than a row for
    each second of the period, or a row for each microsecond of a second.
    """
    lives_of = F.max(F.when(F.col("at").isNotNull(), F.col("ends")))
    last = F.lit(NEVER).cast("timestamp_ntz")  # rows without a time stand behind all others
    times = (
        long.withColumn("second", F.coalesce(F.date_trunc("second", "at").cast("timestamp_ntz"), last))
        .groupBy("src_table", "key", "second", "at")
        .agg(F.max("ends").alias("ends"), F.max("parent").alias("parent"), F.min("parent").alias("only_parents"))
    )
    seconds = times.groupBy("src_table", "key", "second").agg(lives_of.alias("ends"), F.max("parent").alias("parent"), F.min("only_parents").alias("only_parents"))
    of_key = W.partitionBy("src_table", "key")
    known = (
        seconds.withColumn("carried", F.max("ends").over(of_key.orderBy("second").rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("has_parent", F.max("parent").over(of_key))
        .filter("only_parents = 0")
        .select(F.col("src_table").alias("s"), F.col("key").alias("k"), F.col("second").alias("t"), "carried", "has_parent")
    )
    met = times.join(known, (F.col("src_table") == F.col("s")) & (F.col("key") == F.col("k")) & (F.col("second") == F.col("t"))).drop("s", "k", "t")
    # both uses of the times need all of their columns, so their shuffle is done once
    so_far = W.partitionBy("src_table", "key", "second").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return (
        met.withColumn("lives", F.greatest("carried", lives_of.over(so_far)))
        .filter((F.col("only_parents") == 0) & (F.col("at").isNull() | F.col("lives").isNull() | (F.col("lives") <= F.col("at"))))
        .select("src_table", "key", "at", F.when(F.greatest("has_parent", "parent") == 0, "missing").when(F.col("lives").isNotNull() & F.col("at").isNotNull(), "deleted").otherwise("late").alias("kind"))
    )


def find_orphans(links: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Child rows without a living parent at their own time: src_table, row_id, period, kind.

    kind is ``missing`` if no parent row ever has the key, ``deleted`` if one was loaded by then,
    else ``late``; period is the month. orphan_times tells which keys are orphans at which times;
    the rows are joined to these by key and time only then. That join gathers nothing: a hot key
    that is an orphan is split by AQE's skew join, which splits the side of the rows. Missing keys
    are no references. A child without a time is an orphan (``missing`` or ``late``) of no
    period; a parent without a time only proves its key.
    """
    rows = None
    for src, child, ck, *_ in links:
        c = child.select(F.lit(src).alias("src_table"), clean(ck).alias("key"), _time().alias("at"), F.col("row_id").cast("long").alias("row_id")).filter(F.col("key") != "")
        rows = c if rows is None else rows.unionByName(c)
    o = orphan_times(tagged_keys(links)).select(F.col("src_table").alias("s"), F.col("key").alias("k"), F.col("at").alias("t"), "kind")
    # NULL times meet as equal: a reference without a time is still a reference
    met = rows.join(o, (F.col("src_table") == F.col("s")) & (F.col("key") == F.col("k")) & F.col("at").eqNullSafe(F.col("t")))
    return met.select("src_table", "row_id", F.date_format("at", "yyyy-MM").alias("period"), "kind")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period and kind."""
    return orphans.groupBy("src_table", "period", "kind").agg(F.count(F.lit(1)).alias("n"))
