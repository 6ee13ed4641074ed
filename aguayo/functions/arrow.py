"""Helpers for operators that pass Arrow batches through Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def rows_out(schema: pa.Schema, rows: Iterable[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded size."""
    buf: list[tuple] = []
    for r in rows:
        buf.append(r)
        if len(buf) >= size:
            yield _batch(schema, buf)
            buf = []
    if buf:
        yield _batch(schema, buf)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
