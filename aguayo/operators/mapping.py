"""Declarative mappings of a source to a target schema: one select, and the same as SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.sqltext import clean_sql, first_non_empty_sql


@dataclass(frozen=True)
class Clean:
    column: str

    def expr(self) -> Column:
        return text.clean(self.column)

    def sql(self) -> str:
        return clean_sql(self.column)

    def needs(self) -> tuple[str, ...]:
        return (self.column,)


class First:
    """First value that is not empty after cleaning."""

    def __init__(self, *columns: str):
        self.columns = columns

    def expr(self) -> Column:
        return text.first_non_empty(*self.columns)

    def sql(self) -> str:
        return first_non_empty_sql(*self.columns)

    def needs(self) -> tuple[str, ...]:
        return self.columns


@dataclass(frozen=True)
class Const:
    value: str = ""

    def expr(self) -> Column:
        return F.lit(self.value)

    def sql(self) -> str:
        return f"'{self.value}'"

    def needs(self) -> tuple[str, ...]:
        return ()


@dataclass(frozen=True)
class ItemId:
    prefix: str
    column: str

    def expr(self) -> Column:
        return text.item_id(self.prefix, self.column)

    def sql(self) -> str:
        return f"'{self.prefix}:' || {clean_sql(self.column)}"

    def needs(self) -> tuple[str, ...]:
        return (self.column,)


Target = dict[str, Clean | First | Const | ItemId]


def required_columns(mapping: Target) -> list[str]:
    return list(dict.fromkeys(c for m in mapping.values() for c in m.needs()))


def apply_mapping(df: DataFrame, mapping: Target) -> DataFrame:
    """The columns of the mapping in its order; other columns are not read. Missing columns raise."""
    from .checks import require_columns

    require_columns(df, required_columns(mapping), "mapping")
    return df.select(*[m.expr().alias(t) for t, m in mapping.items()])


def mapping_sql(mapping: Target, source: str) -> str:
    return "SELECT " + ", ".join(f"{m.sql()} AS {t}" for t, m in mapping.items()) + f" FROM {source}"


def prefixed(df: DataFrame, fields: list[str], prefix: str, key: str) -> DataFrame:
    """The fields, all but the key renamed with the prefix."""
    return df.select(*[F.col(f).alias(f if f == key else prefix + f) for f in fields])
