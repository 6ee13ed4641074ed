"""Evaluation passages inside training text: a broadcast hash set of n-grams, then verified stretches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, rows_out
from ..functions.lineage import checkpointed, spread
from .canon import edits

N = 5  # words of an n-gram; the one in the middle may differ
REMEMBERED = 64  # letters of the longest words whose comparisons are remembered
EDGE = 2  # words on each side of a stretch by which its surroundings are told apart
WHOLE = 0.8  # share of an item's words from which a stretch is the item itself, never a formula
ITEM_BYTES = 16_000_000  # text of the items in one broadcast; more items are taken in blocks of this size

_MARKS = re.compile("[̀-ͯ­​-‍﻿]+")
_BROKEN = re.compile(r"(?<=\w)-+[ \t]*\r?\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w+);")
_PIECE = re.compile(rf"{_ENTITY.pattern}|.", re.S)


def words(text: str) -> list[str]:
    """Lower-case words without accents; entities read, words broken at a line end joined."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("ς", "σ")
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text)


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with places in the text as it stands: the same words, found piece by piece."""
    out, where = [], []
    for m in _PIECE.finditer(text):
        c = html.unescape(m[0]) if len(m[0]) > 1 else m[0]
        c = _MARKS.sub("", unicodedata.normalize("NFKD", c.lower())).replace("ς", "σ")
        out.append(c)
        where += [m.span()] * len(c)
    flat, keep, at = "".join(out), [], 0
    for m in _BROKEN.finditer(flat):
        keep += range(at, m.start())
        at = m.end()
    keep += range(at, len(flat))
    return [(m[0], where[keep[m.start()]][0], where[keep[m.end() - 1]][1]) for m in _WORD.finditer("".join(flat[i] for i in keep))]


def near(a: str, b: str) -> bool:
    """Equal but for light spelling: one edit or swap from four letters, two from eight."""
    return a == b or (_alike if len(a) <= REMEMBERED else _alike.__wrapped__)(a, b)


@lru_cache(1 << 16)
def _alike(a: str, b: str) -> bool:
    la, lb = len(a), len(b)
    most = 0 if min(la, lb) < 4 else 1 if min(la, lb) < 8 else 2
    if not most or abs(la - lb) > most or len(set(a) ^ set(b)) > 2 * most:
        return False
    return edits(a, b, most) <= most


def _walk(w: list[str], v: list[str], i: int, j: int, step: int) -> tuple[int, int, list[int]]:
    """Follow the stretch from (i, j) in one direction: last places that agree, and the item words that do.

    Words may differ singly, up to three words may be put in and one left out, a word may be
    cut in two or two joined; behind each such change the next two words must agree.
    """
    same: list[int] = []
    end = (i - step, j - step)
    at = lambda s, k: s[k] if 0 <= k < len(s) else None

    def agree(a: int, b: int) -> bool:
        x, y = at(w, a), at(v, b)
        return x is not None and y is not None and near(x, y)

    while 0 <= i < len(w) and 0 <= j < len(v):
        if near(w[i], v[j]):
            same.append(j)
            end = (i, j)
            i, j = i + step, j + step
            continue
        x, y = at(w, i + step), at(v, j + step)
        if y is not None and w[i] == (v[j] + y if step > 0 else y + v[j]):
            same += [j, j + step]
            end = (i, j + step)
            i, j = i + step, j + 2 * step
            continue
        if x is not None and v[j] == (w[i] + x if step > 0 else x + w[i]):
            same.append(j)
            end = (i + step, j)
            i, j = i + 2 * step, j + step
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 0), (2, 1), (3, 0)):
            a, b = i + di * step, j + dj * step
            if agree(a, b) and (agree(a + step, b + step) or not 0 <= b + step < len(v)):
                i, j = a, b
                break
        else:
            break
    return *end, same


def _mixed(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of the window of N words at each place, without the word in the middle."""
    h = np.zeros(len(at), dtype=np.uint64)
    for i in (0, 1, 3, 4):
        h = (h ^ ids[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _windows(ids: np.ndarray) -> np.ndarray:
    """Places of the windows whose words are all known, but for the one in the middle."""
    if len(ids) < N:
        return np.zeros(0, dtype=np.int64)
    known = ids >= 0
    return np.flatnonzero(known[:-4] & known[1:-3] & known[3:-1] & known[4:])


class Index:
    """The n-grams of the items as a sorted array of keys, with the places where they stand."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, words(t or "")) for i, t in items]
        for x in chain.from_iterable(w for _, w in self.items):
            self.vocabulary.setdefault(x, len(self.vocabulary))
        self.marks = [_number(w) for _, w in self.items]
        flat, starts = self.flat([w for _, w in self.items])
        at = _windows(flat)
        key = _mixed(flat, at)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.ends = np.append(first, len(at)).astype(np.int32)
        self.item = (np.searchsorted(starts, at[order], "right") - 1).astype(np.int32)
        self.place = (at[order] - starts[self.item]).astype(np.int32)

    def flat(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, -1 for unknown ones and twice behind each text; where each text starts)."""
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(chain(w, ("", "")) for w in texts), repeat(-1)), dtype=np.int64)
        return ids, np.cumsum([0, *(len(w) + 2 for w in texts)], dtype=np.int64)[:-1]

    def hits(self, texts: list[list[str]]) -> dict[int, list[tuple[int, int, int]]]:
        """By text: (place, item, place in the item) of the windows that are in the set, in order."""
        ids, starts = self.flat(texts)
        at = _windows(ids)
        if not len(at) or not len(self.keys):
            return {}
        key = _mixed(ids, at)
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[slot] == key
        at, slot = at[same], slot[same]
        text = np.searchsorted(starts, at, "right") - 1
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for t, p, k in zip(text.tolist(), (at - starts[text]).tolist(), slot.tolist()):
            a, z = self.ends[k], self.ends[k + 1]
            out[t] += zip(repeat(p), self.item[a:z].tolist(), self.place[a:z].tolist())
        return out

    def stretches(self, w: list[str], hits, least: int):
        """(item place, first and last document word, item words that agree and where the stretch lies) of every stretch of ``least`` item words."""
        done: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for p, k, q in hits:
            done[k] = [s for s in done[k] if s[1] >= p]  # hits come in order: earlier stretches can't hold them
            if any(a <= p <= z and b <= q <= y for a, z, b, y in done[k]):
                continue  # inside a stretch that is known
            v = self.items[k][1]
            z, y, right = _walk(w, v, p, q, 1)
            a, b, left = _walk(w, v, p - 1, q - 1, -1)
            done[k].append((a, z, b, y))
            if y - b + 1 >= least:
                yield k, a, z, sorted({*left, *right}), b, y


def _blocks(items: DataFrame, item: str, text: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size, fetched one after the other, never all at once."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_BYTES))
    rows = items.select(F.col(item).cast("long"), F.col(text).cast("string")).filter(F.col(text).isNotNull())
    for k in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.filter(F.pmod(F.xxhash64(item), F.lit(n)) == k)).collect()]


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str, item: str, text: str = "text", least: int = 15, formula_share: float = 0.01, formula_least: int = 25, agreeing: float = 0.6,
    formula_in_one_item: bool = False,
) -> DataFrame:
    """Documents that hold a passage of an item: key, item, first_word, last_word (from 0), n_words.

    A stretch counts with its item words from the first to the last that agree; at least
    ``least`` of them, leaving out those covered only by standing formulas, and ``agreeing`` of them word for word or nearly so. One
    row per document, item and stretch. A standing formula is a stretch with the same ends (one word
    more or less) in more different surroundings (the words before and behind it) than
    ``formula_share`` of all distinct texts, and at least in ``formula_least``. So neither copies of
    a text make a formula, with changes elsewhere or without, nor a passage whose ends differ from
    text to text, nor a stretch of ``least`` words that is most of an item. What has ``least`` words
    itself is a formula only if it stands in several items (or with ``formula_in_one_item``):
    a passage that leaked from one item is found in however many texts it stands.

    The set of n-grams (windows of five words whose middle one may differ) is broadcast, documents
    are scanned once without a shuffle; only text hashes and the found stretches are shuffled.
    Larger sets of items are taken block by block. NULL and empty texts hold nothing; repeated
    documents each give their rows; no items or no documents give no rows.
    """
    if key == item:
        raise ValueError("documents and items need keys of different names")
    n_texts = docs.select(F.xxhash64(F.col(text).cast("string"))).distinct().count()
    around = pa.struct([("s", pa.string()), ("at", pa.int64()), ("of", pa.int64())])
    schema = pa.schema([("seen", pa.list_(around)), (key, pa.int64()), (item, pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("agree", pa.list_(pa.int32())), ("low", pa.int32()), ("high", pa.int32()), ("grams", pa.list_(pa.string()))])
    spark = docs.sparkSession
    shortest = max(1, int(agreeing * least))  # characters: words have at least one, and so many agree
    source = spread(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).filter(F.length("t") >= shortest))
    out = None
    for block in _blocks(items, item, text):
        shared = spark.sparkContext.broadcast(Index(block))

        def scan(batches, shared=shared):
            index = shared.value

            def rows():
                for b in batches:
                    ids, texts = columns(b, "k", "t")
                    texts = list(map(words, texts))
                    for at, hits in index.hits(texts).items():
                        w, i, part = texts[at], ids[at], {}
                        for k, a, z, agree, low, high in index.stretches(w, hits, N):
                            v = index.items[k][1]
                            n = high - low + 1
                            if n < max(least, WHOLE * len(v)):
                                s = " ".join(v[low : high + 1])
                                part[s, _number(w[max(0, a - EDGE) : a], w[z + 1 : z + 1 + EDGE]), index.marks[k]] = None
                            if n >= least:
                                yield None, i, index.items[k][0], a, z, agree, low, high, [" ".join(v[q : q + N]) for q in range(low, high - N + 2)]
                        if part:
                            yield [{"s": s, "at": x, "of": o} for s, x, o in part], None, None, None, None, None, None, None, None

            yield from rows_out(schema, rows(), 2_000)

        part = source.mapInArrow(scan, f"seen array<struct<s:string,at:long,of:long>>, `{key}` long, `{item}` long, first_word int, last_word int, agree array<int>, low int, high int, grams array<string>")
        out = part if out is None else out.unionByName(part)
    found = checkpointed(out)
    # stretches counted once for each of their surroundings; each also counts for those that lack its first word, its last one or both
    seen = found.filter("seen is not null").select(F.inline("seen")).groupBy("s", "at").agg(F.min("of").alias("a"), F.max("of").alias("z")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.max("z").alias("z")).withColumn("w", F.split("s", " "))
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a in (0, 1) for z in (0, 1)])
    cores = seen.withColumn("e", F.explode(ends)).filter(F.size("w") - F.col("e.a") - F.col("e.z") >= N)
    cores = cores.groupBy(F.expr("slice(w, e.a + 1, size(w) - e.a - e.z)").alias("w")).agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z")).filter((F.col("n") > formula_share * n_texts) & (F.col("n") >= formula_least))
    if not formula_in_one_item:
        cores = cores.filter((F.size("w") < least) | (F.col("a") < F.col("z")))
    formulas = cores.select(F.explode(F.expr(f"transform(sequence(1, size(w) - {N - 1}), q -> array_join(slice(w, q, {N}), ' '))")).alias("gram")).distinct()
    hits = found.filter("seen is null").drop("seen").withColumn("hit", F.monotonically_increasing_id())
    in_formula = hits.select("hit", F.posexplode("grams").alias("q", "gram")).join(formulas, "gram", "left_semi").groupBy("hit").agg(F.collect_set("q").alias("q"))
    covered = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda q: F.sequence(q, q + N - 1))))
    own = hits.join(in_formula.hint("merge"), "hit", "left").withColumn("formula_words", F.coalesce(F.size(covered(F.col("q"))), F.lit(0)))
    own = own.withColumn("n_words", F.col("high") - F.col("low") + 1 - F.greatest(F.col("formula_words"), F.lit(0)))
    return own.filter((F.col("n_words") >= least) & (F.size("agree") >= agreeing * (F.col("high") - F.col("low") + 1))).select(key, item, "first_word", "last_word", "n_words")


def _number(*lists: list[str]) -> int:
    """The same number for the same words, in every process."""
    return int(xxhash.xxh3_64_intdigest("\n".join(map(" ".join, lists)))) >> 1


def leaked_items(leaks: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item), each pair once."""
    return leaks.select(key, item).distinct()


def remove_leaks(docs: DataFrame, leaks: DataFrame, key: str, text: str = "text", whole: bool = False) -> DataFrame:
    """The documents without what leaked: without the spans, or (``whole``) without the documents.

    With spans, columns of the documents stay as they are but for the text, and ``removed_spans``
    (in place of a column of that name) counts the cuts; overlapping stretches are cut once. Other documents stay unchanged.
    """
    if whole:
        return docs.join(leaks.select(key).distinct(), key, "left_anti")
    k, sp, cuts = "__leak_key", "__leak_spans", "__leak_cuts"  # names that no table is expected to have
    spans = leaks.groupBy(F.col(key).alias(k)).agg(F.sort_array(F.collect_set(F.struct("first_word", "last_word"))).alias(sp))

    @F.pandas_udf("struct<text string, cuts int>")
    def cut(t, s):
        import pandas as pd

        def one(x, sp):
            places, out, at, cuts, done = word_spans(x), [], 0, 0, -1
            for r in sp:
                a, z = max(r["first_word"], done + 1), r["last_word"]
                if a > z:
                    continue
                out.append(x[at : places[a][1]])
                at, cuts, done = places[z][2], cuts + 1, z
            return "".join(out) + x[at:], cuts

        return pd.DataFrame([one(x, sp) for x, sp in zip(t, s)], columns=["text", "cuts"])

    joined = docs.drop("removed_spans").join(spans, docs[key] == F.col(k), "left").drop(k)
    rest = joined.filter(F.col(sp).isNull()).withColumn("removed_spans", F.lit(0)).drop(sp)
    clean = joined.filter(F.col(sp).isNotNull()).withColumn(cuts, cut(F.col(text), F.col(sp))).withColumns({text: F.col(f"{cuts}.text"), "removed_spans": F.col(f"{cuts}.cuts")}).drop(cuts, sp)
    return rest.unionByName(clean)
