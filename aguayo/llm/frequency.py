"""Frequency of every distinct value, by an external sort and a run-length scan."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import rows_out
from ..functions.text import clean


def run_lengths(df: DataFrame, fields: list[str], record: str) -> DataFrame:
    """(field_name, value_text, occurrences, records) of every distinct cleaned value of the fields.

    Pairs of value and record identifier are range-partitioned and sorted on both, and behind them
    on the part of the input they come from: so the pairs of a value that a third of all rows hold
    spread over many partitions, and so do equal pairs (a hot record, or rows without one). Each
    partition is scanned once: a run of equal pairs is one record, a run of equal values one partial
    count, which a small aggregate adds up. Only the first and the last pair of a partition can
    stand in another one as well; these are handed on by name (``edge``) and counted once. Missing
    values and NULL are no values; a missing record identifier still counts as an occurrence, but
    is no record. Empty tables give no rows.
    """
    named = [F.struct(F.lit(f).alias("field_name"), clean(f).alias("value_text")) for f in fields]
    pairs = (
        df.select(clean(record).alias("record"), F.spark_partition_id().alias("part"), F.inline(F.array(*named)))
        .filter(F.col("value_text") != "")
        .repartitionByRange("field_name", "value_text", "record", "part")
        .sortWithinPartitions("field_name", "value_text", "record")
    )
    schema = pa.schema([("field_name", pa.string()), ("value_text", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64()), ("edge", pa.string())])

    def starts(cols: list[pa.Array], before: tuple | None) -> pa.Array:
        """True where a row differs from the one before it."""
        out = None
        for i, c in enumerate(cols):
            head = pa.array([before is None or c[0].as_py() != before[i]])
            x = pa.concat_arrays([head, pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))])
            out = x if out is None else pc.or_(out, x)
        return out

    def scan(batches):
        first, last, open_run = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            f, v, r = (b.column(b.schema.get_field_index(n)) for n in ("field_name", "value_text", "record"))
            new_value = starts([f, v], last and last[:2])
            new_pair = pc.and_(pc.or_(new_value, starts([r], last and last[2:])), pc.not_equal(r, ""))
            heads = pc.indices_nonzero(new_value).to_pylist()
            pair_sum = [0, *pc.cumulative_sum(pc.cast(new_pair, pa.int64())).to_pylist()]
            edges = ([0] if not heads or heads[0] else []) + heads + [b.num_rows]
            fs, vs, ns, ds = [], [], [], []
            for a, z in zip(edges, edges[1:]):
                n, d = z - a, pair_sum[z] - pair_sum[a]
                if a or (heads and heads[0] == 0):
                    if open_run:
                        for o, x in zip((fs, vs, ns, ds), open_run):
                            o.append(x)
                    open_run = [f[a].as_py(), v[a].as_py(), n, d]
                else:  # the run goes on from the batch before
                    open_run[2] += n
                    open_run[3] += d
            first = first or (f[0].as_py(), v[0].as_py(), r[0].as_py())
            last = (f[-1].as_py(), v[-1].as_py(), r[-1].as_py())
            if fs:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((fs, vs, ns, ds, [None] * len(fs)), schema.types)], schema=schema)
        if open_run:
            edges = [(f, v, 0, -1, r) for f, v, r in {first, last} if r]  # counted above, to be counted by name instead
            yield from rows_out(schema, [(*open_run, None), *edges])

    runs = pairs.mapInArrow(scan, "field_name string, value_text string, occurrences long, records long, edge string")
    return runs.groupBy("field_name", "value_text").agg(F.sum("occurrences").alias("occurrences"), (F.sum("records") + F.count_distinct("edge")).alias("records"))


def value_frequencies(df: DataFrame, fields: list[str], record: str, rare_at_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """run_lengths with a mark: ``rare`` for at most ``rare_at_most`` records, ``common`` for more than
    ``common_share`` of all distinct records, else NULL. Where both hold, ``rare`` wins."""
    # the total, once for each of the given fields: a row per field, joined on the field's name
    every = df.select(clean(record).alias("r")).filter(F.col("r") != "").agg(F.count_distinct("r").alias("all_records"))
    total = every.select("all_records", F.explode(F.array(*map(F.lit, fields))).alias("field_name"))
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > common_share * F.col("all_records"), "common")
    return run_lengths(df, fields, record).join(F.broadcast(total), "field_name").select("field_name", "value_text", "occurrences", "records", mark.alias("mark"))
