"""Sinks: Parquet, CSV with a byte order mark, and order-independent fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import join_files, remove

SHOWN = 100  # groups that a summary lists


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """Columns as text the way a data frame writes them: True and False, NULL as ''."""
    one = lambda n, t: F.when(F.col(f"`{n}`"), "True").when(~F.col(f"`{n}`"), "False") if t == "boolean" else F.col(f"`{n}`").cast("string")
    return df.select(*[F.coalesce(one(n, t), F.lit("")).alias(n) for n, t in df.dtypes])


def write_csv_parts(df: DataFrame, path: str, header: bool = True) -> None:
    """A folder of CSV parts: minimal quoting, quotes doubled, '' for empty. For data of any size."""
    as_text(df).write.mode("overwrite").options(header=header, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file, UTF-8 with a byte order mark, in the order of the frame: for reports and small corpora.

    The path may be any that the session can write, a URI too. Parts are written by the cluster and
    joined as streams of bytes. Their line ends are counted against the rows written, so parts that
    another machine kept to itself raise OSError instead of being missed.
    """
    spark, parts, seen = df.sparkSession, f"{path}.parts", Observation()
    text = as_text(df)
    ends = sum((F.length(f"`{c}`") - F.length(F.replace(f"`{c}`", F.lit("\n"))) for c in df.columns), F.lit(1))
    write_csv_parts(text.observe(seen, F.coalesce(F.sum(ends), F.lit(0)).alias("ends")), parts, header=False)
    try:
        lines = F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), "[^\n]", ""))
        there = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(parts).agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0]
        if there != seen.get["ends"]:
            raise OSError(f"{parts} holds {there} lines instead of {seen.get['ends']}: not all parts are on shared storage")
        name = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c
        join_files(spark, b"\xef\xbb\xbf" + (",".join(map(name, df.columns)) + "\n").encode(), f"{parts}/part-*", path)
    finally:
        remove(spark, parts)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes): equal for equal rows in any order."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def as_table(df: DataFrame, most: int = 200) -> str:
    """A report as aligned text for the console; says so if it has more than ``most`` rows."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(most + 1).collect()]
    lines = [df.columns, *rows[:most]]
    wide = [max(len(x[i]) for x in lines) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, wide)).rstrip() for x in lines) + ("\nmore rows not shown" if len(rows) > most else "")


def summary(df: DataFrame, group: str, timestamp: str) -> str:
    """Rows, columns, distribution and timestamp as text for the console."""
    groups = df.groupBy(group).count()
    rows, n = groups.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    counts = {r[0]: r[1] for r in groups.orderBy(group).limit(SHOWN).collect()}
    more = f" and {n - SHOWN} groups not shown" if n > SHOWN else ""
    return f"rows: {rows}\ncolumns: {len(df.columns)}\n{group}: {counts}{more}\ntimestamp: {timestamp}"
