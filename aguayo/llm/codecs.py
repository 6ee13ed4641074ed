"""Wrong decodings as pairs of encodings, with tables built by rule from Python's own codecs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Encodings as which bytes may have been read by mistake.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "koi8-r", "cp866", "cp1253", "cp1254", "cp1257")
UTF8, SINGLE = "utf-8", "cp1252"  # encodings in which the bytes were written
TRANSFORMS = tuple((w, r) for w in (UTF8, SINGLE) for r in READ_AS if (w, r) not in ((SINGLE, "cp1252"), (SINGLE, "latin-1")))


@lru_cache(64)
def bytes_to_chars(codec: str) -> tuple[str, ...]:
    """The 256 characters of a one-byte encoding; bytes it leaves undefined stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(64)
def chars_to_bytes(codec: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(bytes_to_chars(codec))))}


def garble(text: str, written: str, read: str) -> str | None:
    """How the text looks when written in one encoding and read as the other; None if it can't be written."""
    if written == UTF8:
        raw = text.encode("utf-8")
    else:
        table = chars_to_bytes(written)
        if any(c not in table for c in text):
            return None
        raw = bytes(table[c] for c in text)
    return "".join(map(bytes_to_chars(read).__getitem__, raw))


def foreign(c: str) -> bool:
    """Whether it is a letter of another script: that comes in whole words, never as a single letter among Latin ones."""
    o = ord(c)
    return 0x370 <= o <= 0x45F or 0x460 <= o <= 0xFFFF and c.isalpha() and not 0x1E00 <= o <= 0x1EFF


def plausible(c: str) -> bool:
    """Whether a character may be the original of a sequence: letters, signs of European texts, and all that takes four bytes."""
    o = ord(c)
    if c in chars_to_bytes(SINGLE) and o > 127:  # also half-way back from a text that was read wrongly twice
        return True
    if o > 0xFFFF:
        return unicodedata.category(c)[0] != "C"
    return 0xA0 <= o <= 0x17F or 0x300 <= o <= 0x36F or 0x1E00 <= o <= 0x1EFF or 0x2010 <= o <= 0x203A or 0x2190 <= o <= 0x22FF or c in "€™" or foreign(c)


@lru_cache(64)
def utf8_pattern(read: str) -> re.Pattern:
    """Sequences of characters that are the bytes of one UTF-8 character of two to four bytes."""
    t = bytes_to_chars(read)
    cls = lambda r: "[" + "".join(re.escape(t[b]) for b in r if ord(t[b]) > 127) + "]"
    tail = cls(range(0x80, 0xC0))
    return re.compile(f"{cls(range(0xC2, 0xE0))}{tail}|{cls(range(0xE0, 0xF0))}{tail}{{2}}|{cls(range(0xF0, 0xF5))}{tail}{{3}}")


def utf8_char(seq: str, read: str) -> str | None:
    table = chars_to_bytes(read)
    try:
        c = bytes(table[x] for x in seq).decode("utf-8")
    except (UnicodeDecodeError, KeyError, ValueError):
        return None
    if "\x80" <= c <= "\x9f":  # half-way back, where the sequence holds what no text has
        return c if any("\x80" <= x <= "\x9f" for x in seq) else None
    return c if plausible(c) else None


def ungarble(word: str, written: str, read: str) -> str | None:
    """The word from which garble gives this one; None if there is none."""
    table = chars_to_bytes(read)
    try:
        raw = bytes(table[c] for c in word)
        return raw.decode("utf-8") if written == UTF8 else "".join(map(bytes_to_chars(written).__getitem__, raw))
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(64)
def letter_images(read: str) -> dict[str, str]:
    """What accented Latin letters written in SINGLE look like when read as ``read``: image to letter."""
    t = bytes_to_chars(read)
    out = {}
    for b, c in enumerate(bytes_to_chars(SINGLE)):
        if b >= 0xC0 and c.isalpha() and t[b] != c and ord(t[b]) > 127 and not t[b].isspace():
            out[t[b]] = c
    return out


@lru_cache(64)
def all_images(read: str) -> dict[str, str]:
    """letter_images, and the signs whose images are no letters."""
    t = bytes_to_chars(read)
    signs = {t[b]: c for b, c in enumerate(bytes_to_chars(SINGLE)) if b >= 0x80 and ord(t[b]) > 127 and not t[b].isalpha() and not t[b].isspace()}
    return signs | letter_images(read)


@lru_cache(10_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0] if c.isalpha() else ""


def odd(word: str, images: dict[str, str]) -> bool:
    """Whether an image in the word can't belong there: a sign at a letter, a foreign script, a capital after a small letter.

    Words wholly in another script are never odd.
    """
    latin = any(c.isascii() and c.isalpha() or _script(c) == "LATIN" and c not in images for c in word)
    if not latin:
        return False
    for i, c in enumerate(word):
        if c not in images:
            continue
        before, after = word[i - 1 : i] if i else "", word[i + 1 : i + 2]
        if c.isalpha():
            if _script(c) not in ("LATIN", "MICRO", "FEMININE", "MASCULINE"):
                return True
            if c.isupper() and before.islower() and not word.isupper():
                return True
            if c.isupper() and images[c].islower() and before.isupper() and after.islower():
                return True
        elif unicodedata.category(c)[0] == "P":  # punctuation: only between letters of the same case as its letter
            if c != "’" and before.isalpha() and after.isalpha() and (before.isupper() and after.isupper()) == images[c].isupper():
                return True
        elif before.isalpha() or after.isalpha():
            return True
    return False


@lru_cache(64)
def sign_pattern(read: str) -> re.Pattern | None:
    """Images of signs where only the sign can stand: ° or º after a number, º after n., ¿ before a capital, box drawing."""
    t, own = bytes_to_chars(read), chars_to_bytes(SINGLE)
    image = lambda c: re.escape(t[own[c]]) if t[own[c]] != c and not t[own[c]].isspace() else ""
    parts = []
    if image("°") or image("º"):
        parts.append(rf"(?<=\d)[{image('°')}{image('º')}]")
    if image("º"):
        parts.append(rf"(?<=\bn\.){image('º')}")
    if image("¿"):
        parts.append(rf"(?<!\w){image('¿')}(?=[A-ZÀ-Þ][^?]*\?)")
    boxes = "".join(c for c in t if 0x2500 <= ord(c) <= 0x259F)
    if boxes:
        parts.append(f"[{boxes}]")
    return re.compile("|".join(parts)) if parts else None


@lru_cache(64)
def sign_images(read: str) -> frozenset[str]:
    """Characters at which sign_pattern can match."""
    t, own = bytes_to_chars(read), chars_to_bytes(SINGLE)
    return frozenset(t[own[c]] for c in "°º¿" if t[own[c]] != c and not t[own[c]].isspace()) | frozenset(c for c in t if 0x2500 <= ord(c) <= 0x259F)
