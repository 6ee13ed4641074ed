"""The text rules for SQL users, as SQL functions without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import MISSING_WORDS, WS


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions strip_text(x), clean_text(x), first_non_empty(a, b) and item_id(prefix, key)."""
    words = ", ".join(f"'{w}'" for w in MISSING_WORDS)
    strip = f"regexp_replace(coalesce(x, ''), r'^{WS}+|{WS}+$', '')"
    bodies = {
        "strip_text(x STRING)": strip,
        "clean_text(x STRING)": f"CASE WHEN lower({strip}) IN ({words}) THEN '' ELSE regexp_replace({strip}, r'{WS}+', ' ') END",
        "first_non_empty(a STRING, b STRING)": "coalesce(nullif(clean_text(a), ''), clean_text(b))",
        "item_id(prefix STRING, key STRING)": "CASE WHEN clean_text(key) = '' THEN '' ELSE concat(prefix, ':', clean_text(key)) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
    return [h.split("(")[0] for h in bodies]


def percent(x: float) -> str:
    """A share for display, rounded as the driver's language does."""
    return f"{x:.1%}"
