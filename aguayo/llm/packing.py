"""Filling containers of a fixed capacity by sum-of-squares online packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, rows_out
from .tokens import RANKS, tokenizer


class SumOfSquares:
    """Online packing: an item goes where the sum of squared counts of partly filled containers gets least.

    ``levels[h]`` counts the open containers filled to h; ``open[h]`` holds their numbers. A container
    that holds only items of size 0 is open at level 0 and is what a new one would be. Ties go to
    the fullest container. Adding to level h changes the sum by 2 (N[h+s] - N[h] + 1), by
    1 - 2 N[h] when it fills up, opening one by 2 N[s] + 1.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill before the item). Items of size 0 go to the fullest open container."""
        cap, n = self.capacity, self.levels
        if size <= 0:
            h = next((h for h in range(cap - 1, 0, -1) if n[h]), 0)
            if not h and not self.open[0]:
                self.open[0].append(self._new())
            return self.open[h][-1], h
        if size >= cap:
            return self._new(), 0
        top = cap - size
        h = np.flatnonzero(n[1 : top + 1]) + 1
        best, at = 2 * n[size] + 1, 0
        if len(h):
            full = h == top
            cost = np.where(full, 1 - 2 * n[h], 2 * (n[h + size] - n[h] + 1))
            i = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[i] <= best:
                at = int(h[i])
        if at:
            c = self.open[at].pop()
            n[at] -= 1
        else:
            c = self._new()
        if at + size < cap:
            self.open[at + size].append(c)
            n[at + size] += 1
        return c, at

    def _new(self) -> int:
        """An empty container: the open one, if items of size 0 have opened one, else the next number."""
        if self.open[0]:
            return self.open[0].pop()
        self.n += 1
        return self.n - 1


def pack_rows(rows, capacity: int, base: int) -> Iterator[tuple]:
    """(id, piece, n_tokens, container_id, container_start) for (id, tokens) pairs."""
    s = SumOfSquares(capacity)
    for i, size in rows:
        piece, left = 0, size
        while True:  # only an item that exceeds a container is divided: full containers, then the rest
            part = min(left, capacity)
            c, at = s.place(part)
            piece, left = piece + 1, left - part
            yield i, piece, part, base + c, at
            if left <= 0:
                break


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = 2048, ranks: str = RANKS) -> DataFrame:
    """(key, piece, n_tokens, container_id, container_start): the container of every text.

    A row per text, or per piece of a text that alone exceeds a container: then piece counts from
    1, all but the last piece fill a container. container_start is the token offset inside.
    Tokens are counted and packed in one pass over the scan's own partitions, without a shuffle:
    every partition fills its own containers, numbered by partition, and leaves at most the few
    that are partly filled at its end. So the result depends on how the input is cut, the bounds
    hold for any cut. NULL and empty texts have 0 tokens and join an open container. Repeated
    keys are packed each. Empty tables give no rows.
    """
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("container_id", pa.int64()), ("container_start", pa.int32())])

    def run(batches):
        count = tokenizer(ranks).count
        items = ((i, count(t) if t else 0) for b in batches for i, t in zip(*columns(b, "k", "t")))
        yield from rows_out(schema, pack_rows(items, capacity, TaskContext.get().partitionId() << 32))

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` long, piece int, n_tokens int, container_id long, container_start int")


def container_fill(assigned: DataFrame) -> DataFrame:
    """(container_id, pieces, tokens) of every container."""
    return assigned.groupBy("container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
