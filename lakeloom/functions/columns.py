"""Projection and column derivation (P1-P22) and scalar helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def columns_of_type(df: DataFrame, *types: type[DataType]) -> list[str]:
    """Names of the columns of these types."""
    return [f.name for f in df.schema if isinstance(f.dataType, types)]


def quoted(name: str) -> str:
    """A name with spaces or dots as an identifier."""
    return "`" + name.replace("`", "``") + "`"


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose whole name matches."""
    return df.select(df.colRegex(f"`{pattern}`"))


def select_except(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_at(df: DataFrame, *places: int) -> DataFrame:
    """Columns by ordinal, from 0."""
    return df.select(*(F.col(quoted(df.columns[i])) for i in places))


def missing(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names that df hasn't, by the session's case rule of folding."""
    have = {c.lower() for c in df.columns}
    return [n for n in names if n.lower() not in have]


def distinct_names(df: DataFrame) -> DataFrame:
    """Columns whose name came before get a number (P13), so that each can be named."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if seen[c.lower()] == 1 else f"{c}_{seen[c.lower()]}")
    return df.toDF(*names)


def packed(df: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """Columns as one struct (P10)."""
    return df.withColumn(name, F.struct(*fields)).drop(*fields)


def unpacked(df: DataFrame, name: str) -> DataFrame:
    """A struct's fields as columns."""
    return df.select(*(c for c in df.columns if c != name), f"{name}.*")


def with_all(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Many columns in one projection (P14, P15): a chain of withColumn is analysed once for each link."""
    return df.withColumns(dict(derived))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def case(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """CASE: the first branch that holds (P18); without otherwise, null."""
    first, *rest = branches
    out = reduce(lambda c, b: c.when(b[0], b[1]), rest, F.when(first[0], first[1]))
    return out if otherwise is None else out.otherwise(otherwise)


def tier(value: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first step whose least value is reached; steps fall."""
    return case(*((value >= least, label) for least, label in steps), otherwise=otherwise)


def flags(column: Column, values: Sequence[str], prefix: str = "is_") -> dict[str, Column]:
    """A 0/1 column for each value."""
    return {f"{prefix}{v.lower()}": (column == v).cast("int") for v in values}


def as_type(column: Column, kind: str) -> Column:
    """A cast that gives null where the value doesn't fit."""
    return column.try_cast(kind)


def or_text(column: Column, default: str) -> Column:
    """The value as text, or the default: a typed default can't be told from a failed cast under ANSI."""
    return F.coalesce(column.cast("string"), F.lit(default))


def first_of(*columns: Column) -> Column:
    return F.coalesce(*columns)


def date_of(column: Column, *formats: str) -> Column:
    """A date by the first format that parses; else null."""
    return F.coalesce(*(F.try_to_date(column, f) for f in formats))


def ratio(top: Column, bottom: Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """top / bottom * scale, null where bottom is 0."""
    out = F.try_divide(top, bottom) * scale
    return out if digits is None else F.round(out, digits)


def days(first: Column, last: Column) -> Column:
    return F.datediff(last, first)
