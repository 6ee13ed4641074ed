"""Token counts of texts: of a public tokenizer's rank file, or of words and signs."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import regex

# Default place of the vocabulary; a parameter of every operator that counts tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORDS = "words"  # in place of a path: runs of letters and numbers, and each other sign, as one token each

# Fixed value: the public pattern that splits text before the merges of a byte-level rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BPE = regex.compile(PATTERN)
_WORD = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")
LONG = 64  # characters from which a part is not kept in the memo


class _Memo(dict):
    """Token counts of pre-split parts; emptied when full, so memory stays bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> int:
        n = len(self.encode(part))
        if len(part) <= LONG:
            if len(self) > 200_000:
                self.clear()
            self[part] = n
        return n


class Bpe:
    """Counts of a byte-level rank file. Merges never cross parts, so a text counts as the sum of its parts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo = _Memo(self.encode)

    def count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, _BPE.findall(text)))

    def parts(self, text: str, most: int = 1 << 30) -> tuple[list[int], list[int]]:
        """Starts of the parts and their token counts; a part of more than ``most`` tokens comes in chunks that have less."""
        starts, sizes = [], []
        for m in _BPE.finditer(text):
            a, z = m.span()
            n = self.memo[m[0]]
            step = max(1, most // 4) if n > most else z - a  # a character has at most four tokens
            for i in range(a, z, step):
                starts.append(i)
                sizes.append(n if step == z - a else self.memo[text[i : min(z, i + step)]])
        return starts, sizes


class Words:
    """Longest runs of letters and numbers, and every other sign that is not white space, as one token each."""

    def count(self, text: str) -> int:
        return len(_WORD.findall(text))

    def parts(self, text: str, most: int = 0) -> tuple[list[int], list[int]]:
        starts = [m.start() for m in _WORD.finditer(text)]
        return starts, [1] * len(starts)


@lru_cache(8)
def tokenizer(path: str) -> Bpe | Words:
    """One a process and path."""
    return Words() if path == WORDS else Bpe(path)
