"""The text rules as SQL for DuckDB, the oracle's side of functions.text."""

from __future__ import annotations

from ..functions.text import MISSING_WORDS, WS


def strip_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in MISSING_WORDS)
    return f"CASE WHEN lower({strip_sql(x)}) IN ({words}) THEN '' ELSE regexp_replace({strip_sql(x)}, '{WS}+', ' ', 'g') END"


def first_non_empty_sql(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({clean_sql(x)}, '')" for x in xs) + ", '')"
