"""Deliveries as a stream: the row-local rules of a contract split it, batches are written once.

The curation itself is a batch job; what can be told from one row alone can be told as rows arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, strip
from ..operators.contract import Contract


def cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with these columns cleaned; works on streams and tables alike."""
    return df.withColumns({c: clean(c) for c in columns})


def broken_rules(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows with ``broken_rules``, the names of the row-local rules they violate ([] if none).

    A column of that name is replaced. Unique keys need all rows and are left to the batch checks.
    """
    full = lambda f: strip(f) != ""
    rules = [F.when(strip(f) == "", F.lit(f"required {f}")) for f in contract.required]
    rules += [F.when(full(f) & ~F.col(f).isin(*v), F.lit(f"allowed {f}")) for f, v in contract.allowed.items()]
    rules += [F.when(full(f) & ~F.col(f).rlike(p), F.lit(f"pattern {f}")) for f, p in contract.patterns.items()]
    return df.withColumn("broken_rules", F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>"))


def write_once(accepted: str, rejected: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch goes to folders of its own number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ok = F.size("broken_rules") == 0
        batch.filter(ok).drop("broken_rules").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        batch.filter(~ok).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return write
