"""Cutting oversized texts at natural boundaries by agglomerative merging of segments."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, rows_out
from ..functions.lineage import spread
from .tokens import RANKS, tokenizer

# Boundaries from the strongest to the weakest: blank line, line end, sentence, clause, comma, space.
_LEVELS = [
    regex.compile(r"\n[^\S\n]*\n\s*"),
    regex.compile(r"\n\s*"),
    regex.compile(r"[.!?…。！？][\"'»”’)\]]*\s+(?=[^\p{Ll}\s])"),
    regex.compile(r"[;:—–][\"'»”’)\]]*\s+"),
    regex.compile(r",\s+"),
    regex.compile(r"\s+"),
]
SENTENCE, INSIDE = 2, len(_LEVELS)  # strengths count down: level 0 is the strongest, INSIDE a cut in a word


def _segments(text: str, starts: list[int], total: list[int], room: int) -> list[tuple[int, int]]:
    """Atomic segments as (first part, level of the boundary before it); none has more than ``room`` tokens.

    Sentences and lines to begin with; only a segment over the room is cut at weaker levels.
    """
    out: list[tuple[int, int]] = []

    def cut(a: int, z: int, before: int, level: int) -> None:
        if total[z] - total[a] <= room and level > SENTENCE:
            out.append((a, before))
            return
        if level > INSIDE:
            out.append((a, before))
            return
        if level == INSIDE:
            at, i = [], a
            while total[z] - total[i] > room:  # parts as they come, as many as fit
                i = max(i + 1, bisect_right(total, total[i] + room) - 1)
                if i < z:
                    at.append(i)
        else:
            lo, hi = starts[a], starts[z] if z < len(starts) else len(text)
            at = sorted({j for m in _LEVELS[level].finditer(text, lo, hi) if a < (j := bisect_right(starts, m.end()) - 1) < z and total[j] > total[a]})
        prev, b = a, before
        for j in [*at, z]:
            cut(prev, j, b, level + 1)
            prev, b = j, level

    cut(0, len(starts), 0, 0)
    return out


def split_spans(text: str, tok, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, repeated tokens) of each piece in characters; one piece if the text fits.

    Adjacent segments wait in a heap, the weakest boundary first and among equals the smaller pair,
    and merge while their size plus the overlap fits the limit.
    """
    n = tok.count(text)
    if n <= limit:
        return [(0, len(text), n, 0)]
    room = limit - overlap
    starts, sizes = tok.parts(text, room)
    total = [0, *accumulate(sizes)]
    seg = _segments(text, starts, total, room)
    first = [a for a, _ in seg]
    size = [total[z] - total[a] for a, z in zip(first, [*first[1:], len(starts)])]
    level = [b for _, b in seg]
    prev, nxt, alive = list(range(-1, len(seg) - 1)), [*range(1, len(seg)), -1], [True] * len(seg)
    heap = [(-level[i], size[i - 1] + size[i], i, size[i - 1], size[i]) for i in range(1, len(seg))]
    heapq.heapify(heap)
    while heap:
        _, both, i, l, r = heapq.heappop(heap)
        p = prev[i]
        if not alive[i] or size[p] != l or size[i] != r or both > room:
            continue  # outdated, or too large for good
        size[p], alive[i] = both, False
        nxt[p] = nxt[i]
        if nxt[i] >= 0:
            prev[nxt[i]] = p
            q = nxt[i]
            heapq.heappush(heap, (-level[q], size[p] + size[q], q, size[p], size[q]))
        if prev[p] >= 0:
            heapq.heappush(heap, (-level[p], size[prev[p]] + size[p], p, size[prev[p]], size[p]))
    heads = [first[i] for i in range(len(seg)) if alive[i]]
    out, before = [], 0
    for k, (a, z) in enumerate(zip(heads, [*heads[1:], len(starts)])):
        at = starts[a] if k else 0
        core = total[z] - total[a]
        begin, again = _repeat(text, tok, starts, total, a, before, min(overlap, max(0, limit - core))) if k else (0, 0)
        end = starts[z] if z < len(starts) else len(text)
        out.append((begin, end, tok.count(text[begin:end]), again))  # white space at the end of a piece counts otherwise than inside
        before = begin if k else at
    return out


def _repeat(text: str, tok, starts: list[int], total: list[int], a: int, least: int, overlap: int) -> tuple[int, int]:
    """Where the last ``overlap`` tokens before part ``a`` begin, not before ``least``, and how many they are.

    Where that is inside a part of several tokens, its end with just the missing tokens is taken;
    if it has no such end, the repeat is that part shorter.
    """
    b = bisect_left(total, total[a] - overlap)
    if starts[b] <= least:
        return (least, total[a] - total[bisect_left(starts, least)]) if least else (0, total[a])
    lack = overlap - (total[a] - total[b])
    if lack > 0 and b:
        for i in range(starts[b] - 1, max(starts[b - 1], least), -1):
            if tok.count(text[i : starts[b]]) == lack:
                return i, overlap
    return starts[b], overlap - lack


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 100, ranks: str = RANKS, with_text: bool = True) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens: key, piece, n_tokens, n_repeated, start_char, end_char, piece_text.

    Pieces are in order from 1; each has at most ``limit`` tokens, of which the first
    ``n_repeated`` repeat the end of the piece before: ``overlap`` of them, fewer only where the
    tokenizer cannot cut a word there or the piece before is shorter. Shorter, empty and NULL texts give no
    rows; repeated keys are cut each. A text without any boundary is cut inside. No shuffle: a
    text is cut where it is read. ``with_text=False`` leaves piece_text NULL.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    schema = pa.schema([(key, pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("n_repeated", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("piece_text", pa.string())])

    def run(batches):
        tok = tokenizer(ranks)

        def rows():
            for b in batches:
                for i, t in zip(*columns(b, "k", "t")):
                    spans = split_spans(t, tok, limit, overlap)
                    if len(spans) > 1:
                        for k, (a, z, n, rep) in enumerate(spans, 1):
                            yield i, k, n, rep, a, z, t[a:z] if with_text else None

        yield from rows_out(schema, rows(), 2_000)

    # a token has at least one byte, so shorter texts cannot exceed the limit
    longer = spread(df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).filter(F.octet_length("t") > limit))
    return longer.mapInArrow(run, f"`{key}` long, piece int, n_tokens int, n_repeated int, start_char long, end_char long, piece_text string")
