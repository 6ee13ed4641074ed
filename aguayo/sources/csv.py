"""CSV scans without type inference: every column a string, missing as ''."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import require_file

# Encodings and separators in the order in which they are tried.
ATTEMPTS = (("utf-8-sig", ","), ("utf-8", ","), ("latin-1", ","), ("utf-8-sig", ";"), ("latin-1", ";"))
_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}


def csv_strings(spark: SparkSession, path: str, encoding: str = "utf-8-sig", sep: str = ",", check_long: bool = True, multi_line: bool = True) -> DataFrame:
    """A CSV with header. Text such as NA stays text, empty fields and those of short rows are ''.

    Quotes are escaped by doubling, line ends inside quotes belong to the value, a byte order mark
    is dropped, blank lines are skipped. A missing file raises FileNotFoundError. Rows with more
    fields than the header raise when they are read (``check_long``). Line ends inside quotes make
    a file one task; ``multi_line=False`` reads large files without such line ends in many.
    """
    require_file(spark, path)
    read = spark.read.options(header=True, multiLine=multi_line, escape='"', quote='"', encoding=_NAMES[encoding], sep=sep, mode="PERMISSIVE")
    names = read.csv(path).columns
    if not names:
        raise ValueError(f"no header in {path}")
    if not check_long:
        return read.csv(path).na.fill("")
    bad = "_corrupt_record"
    schema = ", ".join(f"`{n}` string" for n in [*names, bad])
    df = read.option("columnNameOfCorruptRecord", bad).schema(schema).csv(path)
    # both short and long rows are told as corrupt; the number of separators outside quotes decides
    fields = F.length(F.regexp_replace(F.regexp_replace(F.col(bad), '"(?:[^"]|"")*"', ""), f"[^{sep}]", "")) + 1
    first = F.when(F.col(bad).isNotNull() & (fields > len(names)), F.raise_error(F.concat(F.lit("more fields than the header: "), F.col(bad))).cast("string")).otherwise(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")))
    return df.select(first.alias(names[0]), *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names[1:]])


def csv_with_fallback(spark: SparkSession, path: str, attempts: tuple[tuple[str, str], ...] = ATTEMPTS) -> DataFrame:
    """The first attempt that decodes and has more than one column; RuntimeError with all attempts if none has.

    Bytes are checked before: a reader would replace what it cannot decode instead of failing. They
    are checked line by line, for no character of UTF-8 holds the byte of a line end, so large files
    are checked in many tasks.
    """
    require_file(spark, path)
    utf8 = spark.read.text(path).agg(F.coalesce(F.expr("bool_and(is_valid_utf8(value))"), F.lit(True))).first()[0]
    log = []
    for encoding, sep in attempts:
        if encoding.startswith("utf-8") and not utf8:
            log.append(f"{encoding} {sep!r}: cannot be decoded")
            continue
        df = csv_strings(spark, path, encoding, sep)
        if len(df.columns) > 1:
            return df
        log.append(f"{encoding} {sep!r}: one column")
    raise RuntimeError(f"{path}: " + "; ".join(log))
