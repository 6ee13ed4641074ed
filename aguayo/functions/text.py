"""Text rules shared by every operator, as Column expressions (JVM side, no Python UDF).

Missing values are the empty string from the scan on; NULL counts as ''.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points of Unicode white space (9-D, 1C-20, 85, A0, 1680,
# 2000-200A, 2028, 2029, 202F, 205F, 3000), written so that Java and RE2 both accept it.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Spellings of a missing value, in lower case.
MISSING_WORDS = ("nan", "none", "null")

_SENTINEL = f"(?i)^(?:{'|'.join(MISSING_WORDS)})$"
_NAME = re.compile(r"\w+")
_CLEAN = "regexp_replace(trim(regexp_replace(coalesce(`{}`, ''), r'" + WS.replace("{", "{{").replace("}", "}}") + f"+', ' ')), r'{_SENTINEL}', '')"
_STRIP = "regexp_replace(coalesce(`{}`, ''), r'^" + WS.replace("{", "{{").replace("}", "}}") + "+|" + WS.replace("{", "{{").replace("}", "}}") + "+$', '')"
_PY_WS = re.compile(r"\s+")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Edges without white space; NULL gives ''. Inner white space and sentinels stay."""
    if isinstance(c, str) and _NAME.fullmatch(c):
        return F.expr(_STRIP.format(c))
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"^{WS}+|{WS}+$", "")


def clean(c: Column | str) -> Column:
    """Text without white space at its edges, inner runs of it as one space; '' for NULL and sentinels.

    A sentinel must be the whole value, so ``nullx`` and ``n an`` survive; it has no inner white
    space, so it may be looked for after runs collapse. The value is used once in the expression,
    nested calls do not multiply.
    """
    if isinstance(c, str) and _NAME.fullmatch(c):  # parsed at once: wide mappings build far faster than call by call
        return F.expr(_CLEAN.format(c))
    spaced = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"{WS}+", " "))
    return F.regexp_replace(spaced, _SENTINEL, "")


def clean_py(v: str | None) -> str:
    """The same rule for code that already runs in Python."""
    s = (v or "").strip()
    return "" if not s or s.lower() in MISSING_WORDS else _PY_WS.sub(" ", s)


def first_non_empty(*cs: Column | str) -> Column:
    """First value that is not empty after cleaning, cleaned; '' if there is none. Each value is cleaned once."""
    return F.coalesce(F.get(F.array_remove(F.array(*[clean(c) for c in cs]), ""), F.lit(0)), F.lit(""))


def coalesce_non_empty(preferred: Column | str, fallback: Column | str) -> Column:
    return first_non_empty(preferred, fallback)


def item_id(prefix: str, key: Column | str, on_empty: str = "raise") -> Column:
    """``prefix:key`` of the cleaned key. An empty key raises, or gives '' with on_empty='blank'.

    The raise is a second guard only: a column that is pruned is never evaluated, so
    callers count empty keys as well (operators.checks.unique_key_metrics).
    """
    bad = F.raise_error(F.lit(f"empty source id for {prefix}")).cast("string") if on_empty == "raise" else F.lit("")
    return F.coalesce(F.concat(F.lit(prefix + ":"), F.nullif(clean(key), F.lit(""))), bad)


def prefix_of(c: Column | str, n: int = 160) -> Column:
    return F.substring(strip(c), 1, n)


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0.0 for an empty total."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def iso_timestamp_valid(c: Column | str) -> Column:
    """Whether the text is an ISO-8601 date with time; a trailing Z means UTC. NULL gives false."""
    t = _col(c)
    shaped = F.coalesce(t, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return shaped & F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00")).isNotNull()

