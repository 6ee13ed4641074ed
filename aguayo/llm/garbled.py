"""Text read in a wrong encoding: transformations learned from clean near-twins, then applied to all records."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrow import columns, rows_out
from ..functions.lineage import checkpointed, spread
from .codecs import SINGLE, TRANSFORMS, UTF8, all_images, bytes_to_chars, chars_to_bytes, foreign, garble, letter_images, odd, sign_images, sign_pattern, ungarble, utf8_char, utf8_pattern

LOST = "�"
BY_RUNS = -2  # in place of a transformation: runs learned as they are
BY_TWIN = -1  # in place of a transformation: lost characters that the twin still has
# a word with at least one character beyond ASCII; both engines' syntax
WORD = r"[A-Za-z]*+[\x{80}-\x{10FFFF}][A-Za-z\x{80}-\x{10FFFF}]*"
PLAIN = r"^[\p{IsLatin}¿¡«»“”&&[^ªº]]+$"  # words that may be twins
_WORD = re.compile("[A-Za-z]*[\x80-\U0010ffff][A-Za-z\x80-\U0010ffff]*")
_RUNS = re.compile("[^\x00-\x7f]+")
_FOREIGN = re.compile("(?:GREEK|CYRILLIC|HEBREW|ARABIC|ARMENIAN|GEORGIAN|THAI) ")
_CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")  # control characters that no text has (85 is white space)
_OPEN, _CLOSE = "«“‘", "»”’"


def aligned_runs(a: str, b: str) -> list[tuple[str, str]]:
    """Differing runs beyond ASCII at the same places of two words with the same ASCII letters; [] if places differ."""
    x, y = re.split("([A-Za-z])", a), re.split("([A-Za-z])", b)
    if len(x) != len(y):
        return []
    runs = [(p, q) for p, q in zip(x, y) if p != q]
    return runs if all(p and q for p, q in runs) else []


def explanations(dirty: str, clean: str) -> list[int]:
    """Indexes of TRANSFORMS by which every differing run of the dirty word comes from the clean one's."""
    runs = aligned_runs(dirty, clean)
    if not runs:
        return []
    if all(set(g) == {LOST} and len(g) == len(c) for g, c in runs):
        return [BY_TWIN]

    def explains(w: str, r: str) -> bool:
        for g, c in runs:
            out = garble(c, w, r)
            if out == g:
                continue
            # a run may be garbled in part only, or twice
            parts = {c[i:j]: garble(c[i:j], w, r) for i in range(len(c)) for j in range(i + 1, len(c) + 1)} if len(c) <= 4 else {}
            if not (any(v and c.replace(k, v) == g for k, v in parts.items()) or (w == UTF8 and out and garble(out, w, r) == g)):
                return False
        return True

    return [i for i, (w, r) in enumerate(TRANSFORMS) if explains(w, r)]


def strange(word: str, run: str) -> bool:
    """Whether a run is no likely part of a word: no letters, another script, small ones in capitals or capitals after small letters."""
    if not run.isalpha() or any("LATIN" not in unicodedata.name(c, "") for c in run):
        return True
    rest = "".join(re.findall("[A-Za-z]", word))
    return len(rest) > 1 and (run.islower() and rest.isupper() or run.isupper() and rest.islower() and not word.startswith(run))


def learnable(dirty: str, clean: str) -> list[tuple[str, str, bool]]:
    """(run, letters in its place, strange) of a word that no listed encodings explain; [] if its runs differ in more than letters lost to other characters."""
    out = []
    for g, c in aligned_runs(dirty, clean):
        while g and c and g[0] == c[0]:
            g, c = g[1:], c[1:]
        while g and c and g[-1] == c[-1]:
            g, c = g[:-1], c[:-1]
        if not g or not c.isalpha() or LOST in g or any(unicodedata.combining(x) for x in g):
            return []
        out.append((g, c, strange(dirty, g)))
    return out if len(re.findall("[A-Za-z]", dirty)) > 1 else []


def counted_words(long: DataFrame) -> DataFrame:
    """(word, n, letters) of the words beyond ASCII that have ASCII letters."""
    words = long.select(F.explode(F.regexp_extract_all("value", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("letters", F.regexp_replace("word", "[^A-Za-z]", "")).filter(F.col("letters") != "")


def twin_pairs(words: DataFrame) -> DataFrame:
    """(word, twins): every word, with the most frequent plain word of the same ASCII letters.

    Words are counted first, so a hot word is one row; each word meets one twin, never all words
    of its group.
    """
    twin = F.max(F.when(F.col("word").rlike(PLAIN), F.struct("n", "word"))).over(W.partitionBy("letters"))
    return words.withColumn("twin", twin).filter(F.col("twin").isNotNull() & (F.col("twin.word") != F.col("word"))).select("word", F.col("twin.word").alias("twin"))


def explained_words(words: DataFrame) -> DataFrame:
    """(word, twin, why, runs): words that a transformation of their twin explains, with the indexes in ``why``; or with the ``runs`` that none explains."""
    run = pa.struct([("g", pa.string()), ("c", pa.string()), ("strange", pa.bool_())])
    schema = pa.schema([("word", pa.string()), ("twin", pa.string()), ("why", pa.list_(pa.int32())), ("runs", pa.list_(run))])

    def explain(batches):
        def rows():
            for b in batches:
                for w, t in zip(*columns(b, "word", "twin")):
                    why = explanations(w, t)
                    if why:
                        yield w, t, why, []
                    else:  # the rarer of the two may be the clean one
                        why = explanations(t, w)
                        runs = [{"g": g, "c": c, "strange": s} for g, c, s in learnable(w, t)]
                        if why:  # or the other way round, by the runs: see settled
                            yield t, w, why, runs
                        elif runs:
                            yield w, t, [], runs

        yield from rows_out(schema, rows())

    return twin_pairs(words).mapInArrow(explain, "word string, twin string, why array<int>, runs array<struct<g:string,c:string,strange:boolean>>")


def learned_runs(explained: DataFrame, words: DataFrame, support: int) -> list[tuple[str, str, bool]]:
    """(run, letters, strange) seen in at least ``support`` distinct words.

    A run that may stand in a word as it is (hiló, hilé) must be explained so in most of all
    distinct words that hold it.
    """
    rarer = F.when(F.size("why") > 0, F.col("twin")).otherwise(F.col("word")).alias("word")
    runs = explained.select(rarer, F.inline("runs")).groupBy("g", "c", "strange").agg(F.count_distinct("word").alias("n")).filter(F.col("n") >= support).collect()
    likely = sorted({r.g for r in runs if not r.strange})
    holding = dict(zip(likely, words.agg(*[F.sum(F.col("word").contains(g).cast("long")) for g in likely]).first())) if likely else {}
    return [(r.g, r.c, r.strange) for r in sorted(runs, key=lambda r: (-r.n, r.g, r.c)) if r.strange or 2 * r.n > holding[r.g]]


def settled(explained: DataFrame, learned: list[tuple[str, str, bool]]) -> DataFrame:
    """(word, twin, why): where encodings say that the frequent word is garbled, but learned runs that the rare one is, the runs decide."""
    known = [f"{g}\n{c}\n{str(s).lower()}" for g, c, s in learned]
    is_known = lambda x: F.concat_ws("\n", x["g"], x["c"], x["strange"].cast("string")).isin(known)
    by_runs = (F.size("runs") > 0) & F.forall("runs", is_known) if known else F.lit(False)
    turn = F.col("by_runs") & (F.size("why") > 0)
    rows = explained.withColumn("by_runs", by_runs).filter(F.col("by_runs") | (F.size("why") > 0))
    why = F.when(F.col("by_runs"), F.array(F.lit(BY_RUNS))).otherwise(F.col("why"))
    return rows.select(F.when(turn, F.col("twin")).otherwise(F.col("word")).alias("word"), F.when(turn, F.col("word")).otherwise(F.col("twin")).alias("twin"), why.alias("why"))


def further_twins(words: DataFrame, explained: DataFrame, chosen: list[int]) -> DataFrame:
    """(word, twin, why) of words that their most frequent twin does not explain, but another plain word does.

    The chosen transformations are turned round: what a word would be without them is looked up
    among the counted words, so no word meets all others of its letters. The twin must be more
    frequent; of several the most frequent one counts.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("twin", pa.string()), ("why", pa.int32())])

    def turn(batches):
        def rows():
            for b in batches:
                for w, n in zip(*columns(b, "word", "n")):
                    for i in chosen:
                        x = ungarble(w, *TRANSFORMS[i])
                        if x is not None and x != w:
                            yield w, n, x, i

        yield from rows_out(schema, rows())

    rest = words.join(explained.select("word").distinct(), "word", "left_anti")
    turned = rest.select("word", "n").mapInArrow(turn, "word string, n long, twin string, why int")
    plain = words.filter(F.col("word").rlike(PLAIN)).select(F.col("word").alias("twin"), F.col("n").alias("twin_n"))
    met = turned.join(plain, "twin").filter("twin_n > n").groupBy("word").agg(F.max(F.struct("twin_n", "twin", "why")).alias("m"))
    return met.select("word", "m.twin", F.array("m.why").alias("why"))


def choose_transforms(sets: list[tuple[list[int], int]], support: int) -> list[int]:
    """Fewest transformations first: again and again the one that explains most of what is left."""
    left, chosen = [(why, n) for why, n in sets if BY_TWIN not in why], []
    while left:
        score = {i: sum(n for why, n in left if i in why) for why, _ in left for i in why}
        best = min(score, key=lambda i: (-score[i], i))
        if score[best] < support:
            break
        chosen.append(best)
        left = [(why, n) for why, n in left if best not in why]
    return chosen


class Mapping:
    """The learned transformations, ready to be applied to a text."""

    def __init__(self, chosen: list[int], alphabet: str = "", learned: list[tuple[str, str, bool]] = ()):
        self.runs = {g for g, _, _ in learned}
        # signs and other scripts between letters: restored without a twin too
        self.signs = {g: c for g, c, _ in reversed(learned) if all(unicodedata.category(x)[0] == "S" or x.isalpha() and _FOREIGN.match(unicodedata.name(x, "")) for x in g)}
        signs = "|".join(map(re.escape, sorted(self.signs, key=lambda g: (-len(g), g))))
        self.between = re.compile(f"(?<=[a-zA-Z])(?:{signs})(?=[a-zA-Z])") if signs else None
        self.alphabet = frozenset(alphabet)
        self.utf8 = [r for w, r in (TRANSFORMS[i] for i in chosen) if w == UTF8]
        self.single = [r for w, r in (TRANSFORMS[i] for i in chosen) if w == SINGLE]

    def triggers(self) -> str:
        """A regular expression for Java; joined WORDs without a match can hold nothing garbled by these transformations."""
        esc = lambda cs: "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(cs)))
        parts = [f"[{esc(LOST)}\\x{{80}}-\\x{{84}}\\x{{86}}-\\x{{9f}}]"]
        for r in self.utf8:
            t = bytes_to_chars(r)
            parts.append(f"[{esc(t[0xC2:0xF5])}][{esc(t[0x80:0xC0])}]")
        inner, other = set(), set()
        for r in self.single:
            for c in letter_images(r):
                if unicodedata.category(c)[0] == "P" and c != "·":
                    inner.add(c)
                else:
                    other.add(c)
            other.update(sign_images(r))
        if inner:
            parts.append(f"(?<=\\p{{L}})[{esc(inner)}](?=\\p{{L}})")
        other.update(g[0] for g in self.runs)
        if other:
            parts.append(f"[{esc(other)}]")
        return "(?=[\\x{80}-\\x{10FFFF}])(?:" + "|".join(parts) + ")"

    def word(self, word: str) -> int:
        """0 for a word that holds nothing, 1 for one that may be garbled in its text, 2 for one that only a twin can tell."""
        if LOST in word or _CONTROLS.search(word) or any(self._utf8(word, r) is not None for r in self.utf8) or any(odd(word, letter_images(r)) for r in self.single):
            return 1
        if self.between and self.between.search(word):
            return 1
        if self.held(word):
            return 2
        for r in self.single:
            images = letter_images(r)
            for i, c in enumerate(word):
                if c in images and images[c] in self.alphabet and (c.isalpha() or c == "·") and (c.isupper() == images[c].isupper() or not i or not word[i - 1].isalpha()):
                    return 2
        return 0

    def held(self, word: str) -> bool:
        """Whether the word holds a learned run."""
        return any(g in word for g in self.runs)

    def _utf8(self, text: str, read: str) -> str | None:
        """The text with all sequences of the transformation read right; None if there is none."""
        found = []
        for m in utf8_pattern(read).finditer(text):
            c = utf8_char(m[0], read)
            if c is None:
                continue
            last = m[0][-1]
            if last in _CLOSE and c.isalpha() and not text[m.end() : m.end() + 1].isalnum() and text.count(_OPEN[_CLOSE.index(last)], 0, m.start()) > text.count(last, 0, m.start()):
                continue  # it closes a quotation
            found.append((m.start(), m.end(), c))
        # other scripts come as whole words, never as a single letter
        keep = [f for k, f in enumerate(found) if not foreign(f[2]) or any(g[0] == f[1] or f[0] == g[1] for g in found[max(0, k - 1) : k + 2] if g is not f) or _CONTROLS.search(text, f[0], f[1])]
        if not keep:
            return None
        out, at = [], 0
        for a, z, c in keep:
            out += [text[at:a], c]
            at = z
        return "".join(out) + text[at:]

    def restore(self, text: str) -> tuple[bool, str]:
        """(garbled, original as far as it can be restored)."""
        return self.restored(text)[:2]

    def restored(self, text: str) -> tuple[bool, str, list[tuple[str, str]]]:
        """restore, and (word as it was, word as it stands now): several tables may fit a text, and a twin knows better."""
        garbled, words, steps = False, [w for w in dict.fromkeys(_WORD.findall(text)) if LOST not in w], []
        while True:  # text may be garbled more than once; each round makes it shorter
            best = None
            for r in self.utf8:
                x = self._utf8(text, r)
                if x is not None and (best is None or len(x) < len(best)):
                    best, step = x, lambda w, r=r: self._utf8(w, r) or w
            if best is None or best == text:
                break
            text, garbled = best, True
            steps.append(step)
        if not garbled:
            best, fewest = None, None
            union = {k: v for r in self.single for k, v in letter_images(r).items()}
            for r in self.single:
                images = letter_images(r)
                strange = [w for w in _WORD.findall(text) if odd(w, images)]
                signs = sign_pattern(r)
                if strange or signs and signs.search(text):
                    every, table, own = all_images(r), chars_to_bytes(r), bytes_to_chars(SINGLE)
                    x, at = "", 0
                    for m in signs.finditer(text) if signs else ():
                        x += "".join(every.get(c, c) for c in text[at : m.start()]) + own[table[m[0]]]
                        at = m.end()
                    x += "".join(every.get(c, c) for c in text[at:])
                    left = sum(odd(w, union) for w in _WORD.findall(x)), sum(not c.isalpha() for w in strange for c in "".join(every.get(c, c) for c in w))
                    if fewest is None or left < fewest:
                        best, fewest, step = x, left, lambda w, every=every: "".join(every.get(c, c) for c in w)
            if best is not None:
                text, garbled = best, True
                steps.append(step)
        if self.between and self.between.search(text):
            garbled = True  # restored word by word, by the twin if there is one
        return garbled or LOST in text or _CONTROLS.search(text) is not None, text, [(w, reduce(lambda x, f: f(x), steps, w)) for w in words] if steps else []

    def doubtful(self, text: str) -> list[str]:
        """Words that look right, but may be images of others: only a twin can tell."""
        return [w for w in _WORD.findall(text) if self.word(w) == 2]


def find_garbled(df: DataFrame, key: str, fields: list[str], support: int = 3) -> DataFrame:
    """(row_id, field_name, value_text, restored): values with a wrongly decoded sequence.

    1. Words beyond ASCII are counted; words with the same ASCII letters meet their most frequent
       plain twin, and the runs between the letters are aligned.
    2. Transformations (an encoding written, another read) that explain the most aligned runs are
       kept, each with at least ``support`` distinct words of its own. Runs that no listed pair of
       encodings explains are learned as they are, by the same support. Words that their most
       frequent twin does not explain look for another one by these transformations.
    3. They are applied to every value that holds one of their characters. A word that looks right
       in itself counts only if its own twin explains it. A lost character (U+FFFD) always counts;
       it is restored where the twin of its word has one character in its place, else it stays.
    Words of other scripts, signs and decomposed letters are left alone. NULL and '' hold nothing;
    repeated rows come out each; an empty table gives no rows.
    """
    long = df.select(F.col(key).cast("long").alias("row_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])))
    beyond = long.filter(F.col("value").rlike(r"[\x{80}-\x{10FFFF}]"))
    words = checkpointed(counted_words(beyond))
    explained = checkpointed(explained_words(words))
    learned = learned_runs(explained, words, support)
    explained = settled(explained, learned)
    # as many rows as there are sets of transformations that explain a word
    sets = [(list(r.why), r.n) for r in explained.filter(F.col("why")[0] != BY_RUNS).groupBy("why").agg(F.count_distinct("word").alias("n")).collect()]
    chosen = choose_transforms(sets, support)
    if chosen:
        explained = explained.unionByName(checkpointed(further_twins(words, explained, chosen)))
    # the letters beyond ASCII of all twins: twins are PLAIN words or their images, so this is a part of an alphabet at any size
    letters = explained.filter(F.col("why")[0] != BY_RUNS).select(F.explode(F.split(F.regexp_replace("twin", "[\\x00-\\x7f]", ""), "")).alias("c")).distinct().orderBy("c").collect()
    mapping = Mapping(chosen, "".join(r.c for r in letters), learned)
    schema = pa.schema([("row_id", pa.int64()), ("field_name", pa.string()), ("value_text", pa.string()), ("restored", pa.string()), ("sure", pa.bool_()), ("words", pa.list_(pa.struct([("was", pa.string()), ("now", pa.string())])))])
    pair = lambda w, x: {"was": w, "now": x}

    def apply(batches):
        signs = [p for p in (sign_pattern(r) for r in mapping.single) if p]
        memo: dict[str, int] = {}

        def kind(w: str) -> int:
            k = memo.get(w)
            if k is None:
                if len(memo) > 200_000:
                    memo.clear()
                k = memo[w] = mapping.word(w)
            return k

        def rows():
            for b in batches:
                for i, f, t in zip(*columns(b, "row_id", "field_name", "value")):
                    kinds = set(map(kind, _WORD.findall(t)))
                    if 1 in kinds or any(p.search(t) for p in signs):
                        garbled, x, turned = mapping.restored(t)
                        if garbled:
                            yield i, f, t, x, True, [pair(w, w) for w in _WORD.findall(x) if LOST in w or mapping.held(w)] + [pair(*p) for p in turned]
                            continue
                    if 2 in kinds:
                        yield i, f, t, t, False, [pair(w, w) for w in mapping.doubtful(t)]

        yield from rows_out(schema, rows(), 5_000)

    words = F.array_join(F.regexp_extract_all("value", F.lit(WORD), F.lit(0)), " ")
    hits = spread(long).filter(words.rlike(mapping.triggers())).mapInArrow(apply, "row_id long, field_name string, value_text string, restored string, sure boolean, words array<struct<was:string,now:string>>")
    hits = checkpointed(hits)
    wanted = F.array(*[F.lit(i) for i in [*chosen, BY_TWIN, BY_RUNS]])
    twins = explained.filter(F.arrays_overlap("why", wanted)).groupBy("word").agg(F.min("twin").alias("twin"))
    by_signs = F.col("now")
    for g, c in mapping.signs.items():
        by_signs = F.regexp_replace(by_signs, f"(?<=[a-zA-Z]){''.join(f'\\x{{{ord(x):x}}}' for x in g)}(?=[a-zA-Z])", c)
    told = (
        hits.filter(F.size("words") > 0)
        .select("row_id", "field_name", "value_text", "restored", "sure", F.inline(F.array_distinct("words")))
        .join(twins, F.col("was") == F.col("word"), "left")
        .filter(F.col("twin").isNotNull() | F.col("sure"))
        .withColumn("twin", F.coalesce("twin", F.nullif(by_signs, F.col("now"))))
        .groupBy("row_id", "field_name", "value_text", "restored")
        .agg(F.sort_array(F.collect_set(F.when(F.col("twin").isNotNull(), F.struct("now", "twin")))).alias("w"))
        .select("row_id", "field_name", "value_text", F.aggregate("w", F.col("restored"), lambda t, x: F.replace(t, x["now"], x["twin"])).alias("restored"))
    )
    return hits.filter(F.col("sure") & (F.size("words") == 0)).select("row_id", "field_name", "value_text", "restored").unionByName(told)
