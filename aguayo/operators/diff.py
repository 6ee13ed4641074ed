"""Differences between two copies of a table by range partitioning and a streamed merge."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, rows_out
from ..functions.text import clean


def diff_copies(main: DataFrame, mirror: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, diff): ``only_main``, ``only_mirror``, or a field whose cleaned values differ, a row each.

    Both copies are tagged and reduced to one row a side and key, with a map-side part, so a key
    that holds a large part of all rows reaches the range cut as two rows, whether its rows agree
    or not. Then they are cut at the same split points by one range partitioning on the cleaned
    key, sorted inside the partitions and merged in one pass that holds a single key at a time.
    Rows with a missing key are left out; NULL and '' agree; where repeated rows of one side
    disagree, the greatest value of each field counts.
    Extra columns are not read; an empty side makes every key one-sided.
    """
    if key == "diff" or len(set(fields)) < len(fields):
        raise ValueError("the key must not be named diff, and no field may be given twice")
    names = [f"f{i}" for i in range(len(fields))]

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(clean(key).alias("k"), F.lit(n).alias("s"), *[clean(f).alias(a) for f, a in zip(fields, names)]).filter(F.col("k") != "")

    rows = side(main, 0).unionByName(side(mirror, 1)).groupBy("k", "s").agg(*[F.max(a).alias(a) for a in names])
    both = rows.repartitionByRange("k").sortWithinPartitions("k", "s")
    schema = pa.schema([(key, pa.string()), ("diff", pa.string())])

    def merge(batches):
        def settle(k, have):
            if have[0] is None or have[1] is None:
                yield k, "only_mirror" if have[0] is None else "only_main"
            else:
                for f, a, b in zip(fields, *have):
                    if a != b:
                        yield k, f

        def rows():
            at, have = None, [None, None]
            for b in batches:
                for k, s, *v in zip(*columns(b, "k", "s", *names)):
                    if k != at:
                        if at is not None:
                            yield from settle(at, have)
                        at, have = k, [None, None]
                    have[s] = v
            if at is not None:
                yield from settle(at, have)

        yield from rows_out(schema, rows())

    return both.mapInArrow(merge, f"`{key}` string, diff string")
