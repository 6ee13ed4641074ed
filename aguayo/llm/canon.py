"""Mapping free-typed values to a reference list: embedded mentions first, token-set similarity for the rest.

How well a name fits a value depends on the two alone, never on other names, so a reference list
of any size may be taken block by block and the best fit over all blocks is the same.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, rows_out
from ..functions.lineage import checkpointed, spread
from ..functions.text import clean
from .codecs import TRANSFORMS, UTF8, all_images, letter_images, odd, utf8_char, utf8_pattern

BLOCK_BYTES = 500_000  # names of the reference list in one broadcast; longer lists are taken in blocks of this size
# Words that carry no name.
SMALL_WORDS = frozenset("de del la el en por a of the".split())
SIMILAR = 0.6  # least share of common words in all words of a value and a name
ANY = "�"  # a character that is lost or was read wrongly; it agrees with every character

_SPACES = re.compile(r"[\s_\-–—/|]+")
_EDGE = re.compile(r"[¿?¡!«»“”\"'()\[\]{}*;:#]+")
_BEYOND = re.compile("[^a-z0-9 .,�]")


def fold(text: str) -> str:
    """Lower case without accents; hyphens and line signs as spaces, marks of doubt and quotes dropped."""
    t = unicodedata.normalize("NFKD", text.casefold())
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = _EDGE.sub(" ", _SPACES.sub(" ", t))
    return " ".join(_BEYOND.sub(ANY, t).split())


def readings(text: str) -> list[str]:
    """The text, and what it may have been before a wrong decoding, all folded."""
    out = [text]
    if not text.isascii():
        for w, r in TRANSFORMS:
            if w == UTF8:
                x = text
                while True:  # each round makes it shorter
                    y = utf8_pattern(r).sub(lambda m, r=r: utf8_char(m[0], r) or m[0], x)
                    if y == x:
                        break
                    x = y
                if x != text:
                    out.append(x)
            else:
                words = text.split()
                if any(odd(w, letter_images(r)) for w in words):
                    every = all_images(r)
                    out.append("".join(every.get(c, c) for c in text))
    return list(dict.fromkeys(fold(t) for t in out))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two texts; most + 1 if there are more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    older, row = None, list(range(lb + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * lb
        for j in range(max(1, i - most), min(lb, i + most) + 1):
            y = b[j - 1]
            c = row[j - 1] + (x != y and x != ANY)
            if row[j] + 1 < c:
                c = row[j] + 1
            if new[j - 1] + 1 < c:
                c = new[j - 1] + 1
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and older[j - 2] + 1 < c:
                c = older[j - 2] + 1
            new[j] = c
        if min(new) > most:
            return most + 1
        older, row = row, new
    return min(row[lb], most + 1)


def allowance(n: int) -> int:
    """Most edits between a value and a name of n characters."""
    return min(n // 2, 1 if n <= 4 else 2 if n <= 12 else 3)


def light(n: int) -> int:
    """Most edits of a word of n letters among other words."""
    return 0 if n < 4 else 1 if n < 8 else 2


def letters(word: str) -> int:
    """Characters that are known."""
    return len(word) - word.count(ANY)


PREFIX = 8  # letters whose deletions are indexed; at least one more than the most edits


def _deletions(word: str, most: int) -> set[str]:
    """The beginning of the word and what is left of it without up to ``most`` letters."""
    out = level = {word[:PREFIX]}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


class Near:
    """Finds the listed words within their allowance of edits: such words share a beginning but for as many deletions."""

    def __init__(self, words: dict[str, int]):
        """``words``: the most edits of each."""
        self.words, self.edits = sorted(words), words
        self.index: dict[str, list[int]] = defaultdict(list)
        for k, w in enumerate(self.words):
            for d in _deletions(w, words[w]):
                self.index[d].append(k)
        self.most = max(words.values(), default=0)
        self.alphabet = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}
        self.bags: np.ndarray | None = None
        self.memo: dict[str, list[tuple[int, str]]] = {}

    def _bag(self, t: str) -> list[int]:
        v = [0] * (len(self.alphabet) + 1)
        for c in t:
            v[self.alphabet.get(c, len(self.alphabet))] += c not in (" ", ANY)
        return v

    def _possible(self, word: str):
        if ANY not in word:
            return sorted({k for d in _deletions(word, self.most) for k in self.index.get(d, ())})
        # a lost character agrees with all others, so letters are counted instead
        if self.bags is None:
            self.bags = np.array([self._bag(w) for w in self.words], dtype=np.int16).reshape(len(self.words), len(self.alphabet) + 1)
        diff = self.bags - np.array(self._bag(word), dtype=np.int16)
        return np.flatnonzero(np.maximum(np.maximum(diff, 0).sum(1) - word.count(ANY), np.maximum(-diff, 0).sum(1)) <= self.most)

    def find(self, word: str) -> list[tuple[int, str]]:
        """(edits, listed word), fewest edits first; a beginning with a full stop stands for its words."""
        found = self.memo.get(word)
        if found is None:
            stem, out = word.rstrip(".,"), {}
            if stem.strip(ANY):
                for k in self._possible(stem):
                    w = self.words[k]
                    if (d := edits(stem, w, self.edits[w])) <= self.edits[w]:
                        out[w] = d
                if word.endswith(".") and len(stem) > 2:
                    k = bisect_left(self.words, stem)
                    while k < len(self.words) and self.words[k].startswith(stem):
                        out[self.words[k]] = 0
                        k += 1
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[word] = sorted((d, w) for w, d in out.items())
        return found


Fit = tuple[int, int, int, int, str]  # what orders matches: the least is the best; see Terms.fit
NONE: Fit = (0, 9, 0, 0, "none")


class Terms:
    """The names of one field: an automaton over them, an inverted index of their words, and both for light misspellings."""

    def __init__(self, entries: list[tuple[int, str, str | None]], qualifiers: frozenset[str] = frozenset()):
        self.qualifiers = qualifiers
        names = sorted({(fold(n), e) for e, *ns in entries for n in ns if n and fold(n)}, reverse=True)
        self.by_name = dict(names)  # of equal names the one of the smallest entry
        self.automaton = ahocorasick.Automaton()
        for n, e in self.by_name.items():
            self.automaton.add_word(f" {n} ", (n, e))
        self.automaton.make_automaton()
        self.sets = [(e, [w for w in dict.fromkeys(n.split()) if w not in SMALL_WORDS] or n.split()) for n, e in sorted(self.by_name.items())]
        self.with_word: dict[str, list[int]] = defaultdict(list)  # places in sets by word
        for k, (_, ws) in enumerate(self.sets):
            for w in ws:
                self.with_word[w].append(k)
        self.near_word = Near({w: light(len(w)) for w in self.with_word})
        self.joined = {n.replace(" ", ""): e for n, e in sorted(self.by_name.items(), key=lambda x: -x[1])}
        self.near_name = Near({n.replace(" ", ""): allowance(len(n)) for n in self.by_name})

    def mentions(self, words: list[str]) -> list[tuple[int, int, str, int]]:
        """Longest mentions that do not overlap, as (start, end, name, entry) in words; ties go to the left."""
        text = " " + " ".join(words) + " "
        spaces = [i for i, c in enumerate(text) if c == " "]
        found = [(bisect_left(spaces, end - len(n) - 1), n, e) for end, (n, e) in self.automaton.iter(text)]
        out: list[tuple[int, int, str, int]] = []
        taken = bytearray(len(words))
        for i, n, e in sorted(found, key=lambda f: (-len(f[1]), f[0])):
            j = i + n.count(" ") + 1
            if not any(taken[i:j]):
                taken[i:j] = b"\1" * (j - i)
                out.append((i, j, n, e))
        return out

    def similar(self, words: list[str]) -> list[Fit]:
        """Names by their words, in any order: the value as a whole, sets of words, one word among others.

        The value as a whole is one joined word, within the allowance of its length. Sets share at
        least two words, light spelling aside, and SIMILAR of all words of both. A name of one word
        is known in a longer value by a lightly misspelled word of at least five letters.
        """
        out: list[Fit] = []
        whole = "".join(w.rstrip(".,") for w in words)
        for d, n in self.near_name.find(whole):
            out.append((d - letters(whole), 1, d, self.joined[n], "similar"))
        words = [w for w in dict.fromkeys(words) if w.strip(".," + ANY) and w.rstrip(".,") not in SMALL_WORDS]
        near = {w: {v: d for d, v in self.near_word.find(w)} for w in words}
        for k in sorted({k for vs in near.values() for v in vs for k in self.with_word[v]}):
            e, ws = self.sets[k]
            left, shared, d, chars = list(words), 0, 0, 0
            for v in ws:
                w = min((w for w in left if v in near[w]), key=lambda w: near[w][v], default=None)
                if w is not None:
                    left.remove(w)
                    shared, d, chars = shared + 1, d + near[w][v], chars + letters(w.rstrip(".,"))
            if shared == len(words) == len(ws) or shared > 1 and shared >= SIMILAR * (len(words) + len(ws) - shared):
                out.append((d - chars, 1, d, e, "similar"))
            elif shared == len(ws) == 1 and chars > 4:
                out.append((d - chars, 2, d, e, "similar"))
        return out

    def match(self, value: str) -> tuple[int, str]:
        """(entry, how) of the best fit; entry 0 and ``none`` without one."""
        return self.fit(value)[3:]

    def fit(self, value: str) -> Fit:
        """The best fit: explained letters less the edits (negative), kind, edits, entry, how.

        ``how`` is ``mention``, ``similar`` or ``none``. The longest exact mention stands unless a
        name by its words explains more of the value. Ties go to mentions, fewer edits, smaller entries.
        """
        best = NONE
        if not self.by_name:
            return best
        for text in readings(value):
            words = [w for w in text.split(" ") if w.strip(".,")]
            words = [w for w in words if w.rstrip(".,") not in self.qualifiers] or words
            bare = [w.rstrip(".,") for w in words]
            found = self.mentions(bare)
            fits: list[Fit] = []
            if found:
                a, z, _, e = found[0]
                fits.append((-sum(map(letters, bare[a:z])), 0, 0, e, "mention"))
            covered = {i for a, z, _, _ in found for i in range(a, z)}
            if not found or any(i not in covered and w not in SMALL_WORDS for i, w in enumerate(bare)):
                fits += self.similar(words)
            best = min([best, *fits])
        return best


_BUILT: dict[tuple, dict[str, Terms]] = {}  # one a worker


def _terms(shared, qualifiers: frozenset[str]) -> dict[str, Terms]:
    key = (shared.value[0], qualifiers)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = {f: Terms(e, qualifiers) for f, e in shared.value[1].items()}
    return _BUILT[key]


def _blocks(listed: DataFrame):
    """The reference list in blocks of bounded size, fetched one after the other, as {field: [(entry, label, alias)]}."""
    size = listed.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws("", "l", "a")) + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        entries = defaultdict(list)
        for r in (listed if n == 1 else listed.filter(F.pmod(F.xxhash64("f", "e"), F.lit(n)) == k)).collect():
            entries[r.f].append((r.e, r.l, r.a))
        yield n, dict(entries)


def map_values(
    df: DataFrame, terms: DataFrame, key: str, fields: list[str], field_col: str = "field_name", entry: str = "entry_id", label: str = "label", alias: str = "label_en",
    qualifiers: frozenset[str] = frozenset(),
) -> DataFrame:
    """(row_id, field_name, value_text, entry_id, how) of every value that is no label of its field.

    Values equal to a label after cleaning are left out, missing ones too. entry_id is the entry
    meant, 0 if the list has none; ``how`` tells how it was found. An automaton over labels and
    aliases finds embedded mentions (whole words, longest first, without overlap). If words remain
    beside them, or there are none, token-set similarity over an inverted index of the names' words
    follows; it wins if it explains more of the value than the longest mention. ``qualifiers`` are
    words to be passed over (none by default). NULL labels and aliases are ignored; repeated rows
    come out each; without terms every value has entry 0; an empty table gives no rows.

    A list of up to BLOCK_BYTES is broadcast and values are matched where they are read, without a
    shuffle, each once a task. A longer one is taken in blocks, each against all distinct values,
    and the best fit over the blocks is joined back to the rows.
    """
    listed = terms.select(F.col(field_col).alias("f"), F.col(entry).cast("long").alias("e"), F.col(label).alias("l"), F.col(alias).alias("a"))
    spark = df.sparkSession
    long = spread(df.select(key, *fields)).select(F.col(key).cast("long").alias("row_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), clean(f).alias("value_text")) for f in fields]))).filter(F.col("value_text") != "")
    labels = listed.filter("l is not null").select(F.col("f").alias("field_name"), F.col("l").alias("value_text")).distinct()
    other = long.join(labels, ["field_name", "value_text"], "left_anti").select("row_id", "field_name", "value_text")

    def matched(rows: DataFrame, shared) -> DataFrame:
        schema = pa.schema([("row_id", pa.int64()), ("field_name", pa.string()), ("value_text", pa.string()), ("score", pa.int32()), ("kind", pa.int32()), ("edits", pa.int32()), ("entry_id", pa.int64()), ("how", pa.string())])

        def run(batches):
            built, memo = _terms(shared, qualifiers), {}

            def out():
                for b in batches:
                    for i, f, v in zip(*columns(b, "row_id", "field_name", "value_text")):
                        m = memo.get((f, v))
                        if m is None:
                            if len(memo) > 200_000:
                                memo.clear()
                            m = memo[f, v] = built[f].fit(v) if f in built else NONE
                        yield i, f, v, *m

            yield from rows_out(schema, out())

        return rows.mapInArrow(run, "row_id long, field_name string, value_text string, score int, kind int, edits int, entry_id long, how string")

    fits = distinct = None
    for n, block in _blocks(listed):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        if n == 1:
            return matched(other, shared).select("row_id", "field_name", "value_text", "entry_id", "how")
        if distinct is None:
            distinct = checkpointed(other.select(F.lit(0).cast("long").alias("row_id"), "field_name", "value_text").distinct())
        part = checkpointed(matched(distinct, shared))
        fits = part if fits is None else fits.unionByName(part)
    best = fits.groupBy("field_name", "value_text").agg(F.min(F.struct("score", "kind", "edits", "entry_id", "how")).alias("m")).select("field_name", "value_text", "m.entry_id", "m.how")
    return other.join(best, ["field_name", "value_text"]).select("row_id", "field_name", "value_text", "entry_id", "how")


def unmatched(mapped: DataFrame) -> DataFrame:
    """(field_name, value_text, rows) of the values without an entry."""
    return mapped.filter(F.col("entry_id") == 0).groupBy("field_name", "value_text").agg(F.count(F.lit(1)).alias("rows"))
