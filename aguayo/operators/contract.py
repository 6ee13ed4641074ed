"""Schema contracts: required, unique, allowed and patterned fields, checked by counting violations."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


@dataclass(frozen=True)
class Contract:
    """Ordered fields with rules. ``allowed`` and ``patterns`` apply to non-empty values."""

    fields: tuple[str, ...]
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, spec: dict) -> Contract:
        """From ``{fields: [{name, required, allowed_values, pattern, format}], primary_key, unique}``."""
        fs = spec["fields"]
        names = [f["name"] for f in fs]
        if len(set(names)) < len(names):
            raise ValueError("field names are not unique")
        bad = [f["name"] for f in fs if f.get("required") and f.get("nullable")]
        if bad:
            raise ValueError(f"required fields are nullable: {bad}")
        pk = spec.get("primary_key") or []
        unique = [(pk,) if isinstance(pk, str) else tuple(pk)] if pk else []
        patterns = {f["name"]: f["pattern"] for f in fs if f.get("pattern")} | {f["name"]: "^https?://" for f in fs if f.get("format") == "uri"}
        return cls(tuple(names), tuple(f["name"] for f in fs if f.get("required")), tuple(unique + [tuple(u) for u in spec.get("unique", [])]), {f["name"]: tuple(f["allowed_values"]) for f in fs if f.get("allowed_values")}, patterns)

    @classmethod
    def from_yaml(cls, path: str) -> Contract:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8-sig")))


def violations(df: DataFrame, c: Contract) -> DataFrame:
    """(rule, field, violations) of every rule, all from one aggregate over one pass.

    Violations of a unique key are surplus rows, NULL as a value of its own.
    """
    full = lambda f: strip(f) != ""
    broken = [("required", f, strip(f) == "") for f in c.required] + [("allowed", f, full(f) & ~F.col(f).isin(*v)) for f, v in c.allowed.items()] + [("pattern", f, full(f) & ~F.col(f).rlike(p)) for f, p in c.patterns.items()]
    counts = [(r, f, F.count(F.when(cond, 1))) for r, f, cond in broken]
    counts += [("unique", "+".join(key), F.count(F.lit(1)) - F.count_distinct(F.struct(*key))) for key in c.unique]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[n.alias(f"r{i}") for i, (_, _, n) in enumerate(counts)])
    none = F.array().cast("array<struct<rule:string,field:string,violations:bigint>>")
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(f).alias("field"), F.col(f"r{i}").alias("violations")) for i, (r, f, _) in enumerate(counts)]) if counts else none))
