"""Several values packed in one field: choose a dialect per field by description length, then parse.

A dialect is a quoting style with a set of delimiters. Every field is parsed under each dialect
that its characters allow; a parse costs the bits of naming the dialect plus the code length of
its values, and pays for every structural character left unprotected inside a value. Code lengths
come from a distributed count of values over all candidate parses of the whole column: -log2 of a
value's share plus the part of its spelling that one use has to carry, or the literal spelling.

Two passes over the column, no shuffle but that of the pre-aggregated value counts. Each row
spreads a weight of one over its candidate values, so at most CODEBOOK_SIZE values of a field can
reach the share 1 / CODEBOOK_SIZE: that proves the bound of what is broadcast, at any input size.
The book holds digests of values, so their length does not matter. A value whose weight is that
of one row or less would cost its spelling with a code too, so leaving it out changes nothing.

Structure that holds in every dialect: a delimiter inside quotes, inside round brackets or between
two digits belongs to the value, and words never separate.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, rows_out
from ..functions.lineage import spread
from ..functions.text import MISSING_WORDS

# Characters that can separate values; a line end counts as one of them.
DELIMITERS = (";", "；", ",", "，", "、", "|", "/", "·", "•", "\n", "\t")
CODEBOOK_SIZE = 65_536  # part of the model: a code costs at most 16 bits, rarer values are spelled out
ROW_WEIGHT = 720_720  # divisible by all small numbers of parses and values
ESCAPE_BITS, CHAR_BITS, MARK_BITS, PART_BITS = 6.0, 5.0, 16.0, 4.0

_MARKS = re.compile(r"[;；,，、|/·•\n\t]")
_SPECIAL = re.compile(r"[;；,，、|/·•\n\t\"\[\]{}]")
_PROTECTED = re.compile(r"\([^()]*\)|(?<=\d)[^\w\s](?=\d)")
_BETWEEN_DIGITS = re.compile(r"\d[;；,，、|/·•\n\t]\d")
_ESCAPED = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_ENDS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@lru_cache(4096)
def _parser(quotes: str, delims: frozenset) -> re.Pattern:
    """One value a match: groups quoted-by-each-style..., bare."""
    inside = "".join(re.escape(x) for x in sorted(delims))
    d = f"[{inside}]" if delims else r"(?!)"
    # "c": doubled quotes escape; "b": a backslash escapes, in double or single quotes
    quoted = {"c": r'"((?:[^"]|"")*)"', "b": r'"((?:[^"\\]|\\.)*)"', "s": r"'((?:[^'\\]|\\.)*)'"}
    alts = "|".join(rf"\s*{quoted[q]}\s*(?={d}|\Z)" for q in quotes)
    bare = rf"((?:[^({inside}]++|\([^()]*+\)|\(|(?<=\d){d}(?=\d))*+)"
    return re.compile(f"(?:{alts}|{bare})(?:{d}|\\Z)" if alts else f"{bare}(?:{d}|\\Z)", re.S)


@lru_cache(4096)
def _splitter(delims: frozenset) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(x) for x in sorted(delims)) + "]")


def _undo(m: re.Match) -> str:
    x = m[1]
    return chr(int(x[1:], 16)) if x[0] == "u" and len(x) == 5 else _ENDS.get(x, x)


def _parse(text: str, quotes: str, delims: frozenset) -> tuple[list[str], int]:
    """Values, and how many structural characters stand unprotected inside them."""
    out, bare = [], 0
    for m in _parser(quotes, delims).finditer(text):
        k = m.lastindex or 0
        v = m[k] if k else ""
        if k and k <= len(quotes):
            v = v.replace('""', '"') if quotes[k - 1] == "c" else _ESCAPED.sub(_undo, v)
        elif _SPECIAL.search(v):
            bare += len(_SPECIAL.findall(_PROTECTED.sub("", v)))
        v = v.strip()
        if v:
            out.append(v)
    return out, bare


def _plain_parse(text: str, delims: frozenset) -> tuple[list[str], int]:
    """What _parse gives without quotes for a text in which nothing protects a delimiter."""
    out = [v for v in map(str.strip, _splitter(delims).split(text) if delims else (text,)) if v]
    return out, sum(len(_SPECIAL.findall(v)) for v in out if _SPECIAL.search(v))


def _delimiter_sets(present: list[str]) -> list[frozenset]:
    """All subsets of the delimiters that stand in a text."""
    return [frozenset(c) for n in range(len(present) + 1) for c in combinations(present, n)]


def candidates(text: str) -> list[tuple[float, list[str]]]:
    """(bits of the dialect, values) of each parse the text allows; equal parses once, cheapest first."""
    text = text.strip().replace("\r\n", "\n").replace("\r", "\n")
    found: dict[tuple, float] = {}

    def add(bits: float, values: list[str], bare: int = 0) -> None:
        k = tuple(values)
        bits += MARK_BITS * bare
        if bits < found.get(k, 1e9):
            found[k] = bits

    if len(text) > 1 and text[0] == "[" and text[-1] == "]":
        if '"' in text:
            try:
                x = json.loads(text)
                if all(isinstance(v, str) for v in x):
                    add(PART_BITS, [v.strip() for v in x if v.strip()])
            except ValueError:
                pass
        add(2 * PART_BITS, *_parse(text[1:-1], "bs", frozenset(",")))
    elif len(text) > 1 and text[0] == "{" and text[-1] == "}":
        add(PART_BITS, *_parse(text[1:-1], "b", frozenset(",")))
        add(PART_BITS, *_parse(text[1:-1], "c", frozenset(",")))
    present = sorted(set(_MARKS.findall(text)))
    if '"' not in text and "(" not in text and not _BETWEEN_DIGITS.search(text):
        for delims in _delimiter_sets(present):
            add(PART_BITS * len(delims), *_plain_parse(text, delims))
        return [(b, list(v)) for v, b in found.items()]
    for delims in _delimiter_sets(present):
        bits = PART_BITS * len(delims)
        if '"' in text:
            add(bits + PART_BITS, *_parse(text, "c", delims))
        if not delims or '"' not in text:
            add(bits, *_parse(text, "", delims))
    return [(b, list(v)) for v, b in found.items()]


def literal_bits(v: str) -> float:
    return ESCAPE_BITS + CHAR_BITS * len(v) + (MARK_BITS - CHAR_BITS) * len(_SPECIAL.findall(v))


def digest(v: str) -> int:
    """What the code book knows a value by."""
    return xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass"))


def cheapest(text: str, bits: dict[int, float]) -> list[str]:
    """Values of the parse with the least description length; ties go to more values, then to code point order."""
    c = candidates(text)
    if len(c) == 1:
        return c[0][1]
    get = bits.get
    cost = lambda v: x if (x := get(digest(v))) is not None else literal_bits(v)
    return min(((b + sum(map(cost, vs)), -len(vs), vs) for b, vs in c), default=(0, 0, []))[2]


def _missing(t: str | None) -> bool:
    return not t or not (s := t.strip()) or s.lower() in MISSING_WORDS


def long_form(sources: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """(src_table, row_id, field_name, text) of the packed fields of several tables."""
    out = None
    for name, df, key, fields in sources:
        part = df.select(F.lit(name).alias("src_table"), F.col(key).cast("long").alias("row_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("text").isNotNull() & (F.col("text") != ""))


def value_codes(long: DataFrame, rows_by_source: dict[str, int]) -> dict[tuple[str, str], dict[int, float]]:
    """Code lengths in bits by table and field: of every value with a share of at least 1 / CODEBOOK_SIZE.

    Each task counts equal texts before it parses them, and sums weights before they are shuffled.
    """
    schema = pa.schema([("src_table", pa.string()), ("field_name", pa.string()), ("h", pa.int64()), ("literal", pa.float64()), ("w", pa.int64())])

    def count(batches):
        texts: Counter = Counter()

        def flush():
            seen: dict[tuple, list] = {}
            for (s, f, t), n in texts.items():
                c = candidates(t) if _SPECIAL.search(t) else [(0.0, [t.strip()])]
                for _, vs in c:
                    w = ROW_WEIGHT // (len(c) * len(vs)) * n if vs else 0
                    for v in vs:
                        h = digest(v)
                        old = seen.get((s, f, h))
                        if old is None:
                            seen[s, f, h] = [literal_bits(v), w]
                        else:
                            old[1] += w
            texts.clear()
            yield from rows_out(schema, ((s, f, h - (1 << 64) if h >> 63 else h, lit, w) for (s, f, h), (lit, w) in seen.items()))

        for b in batches:
            texts.update(x for x in zip(*columns(b, "src_table", "field_name", "text")) if not _missing(x[2]))
            if len(texts) > 20_000:
                yield from flush()
        yield from flush()

    counts = long.select("src_table", "field_name", "text").mapInArrow(count, "src_table string, field_name string, h long, literal double, w long").groupBy("src_table", "field_name", "h").agg(F.sum("w").alias("w"), F.min("literal").alias("literal"))
    least = F.coalesce(*[F.when(F.col("src_table") == s, F.lit(max(1, n) * ROW_WEIGHT / CODEBOOK_SIZE)) for s, n in rows_by_source.items()])
    books: dict[tuple[str, str], dict[int, float]] = {}
    for r in counts.filter((F.col("w") >= least) & (F.col("w") > ROW_WEIGHT)).collect():  # at most CODEBOOK_SIZE rows a field, see above
        share_bits = -math.log2(r.w / (rows_by_source[r.src_table] * ROW_WEIGHT))
        books.setdefault((r.src_table, r.field_name), {})[r.h % (1 << 64)] = min(r.literal, max(0.1, share_bits) + r.literal * ROW_WEIGHT / r.w)
    return books


def unpack(sources: list[tuple[str, DataFrame, str, list[str]]], least_values: int = 2) -> DataFrame:
    """One row per value: src_table, row_id, field_name, pos (from 1), value_text.

    Fields with fewer than ``least_values`` values give no row. NULL, '' and spellings of missing
    have no values; empty places are not counted; an unclosed quote is an ordinary character.
    Repeated rows each give their values. Other columns are not read. Empty tables give no rows.
    Tables may have fields of the same name; the names of the tables must differ.
    """
    if len({s for s, *_ in sources}) < len(sources):
        raise ValueError("two sources have the same name")
    rows = {s: df.count() for s, df, _, _ in sources}
    long = spread(long_form(sources))
    books = long.sparkSession.sparkContext.broadcast(value_codes(long, rows))
    schema = pa.schema([("src_table", pa.string()), ("row_id", pa.int64()), ("field_name", pa.string()), ("pos", pa.int32()), ("value_text", pa.string())])

    def parse(batches):
        bits, memo = books.value, {}
        for b in batches:
            src, ids, fs, pos, vals = [], [], [], [], []
            for s, i, f, t in zip(*columns(b, "src_table", "row_id", "field_name", "text")):
                if least_values > 1 and not _SPECIAL.search(t) and "\r" not in t:
                    continue
                vs = memo.get((s, f, t))
                if vs is None:
                    vs = [] if _missing(t) else cheapest(t, bits.get((s, f), {}))
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[s, f, t] = vs
                n = len(vs)
                if n >= least_values:
                    src += [s] * n
                    ids += [i] * n
                    fs += [f] * n
                    pos += range(1, n + 1)
                    vals += vs
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((src, ids, fs, pos, vals), schema.types)], schema=schema)

    return long.mapInArrow(parse, "src_table string, row_id long, field_name string, pos int, value_text string")
