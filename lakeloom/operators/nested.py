"""Nested data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def leaves(schema: StructType, prefix: str = "") -> list[str]:
    """Dot paths of all scalar fields, through structs."""
    out = []
    for f in schema:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, StructType) else [path]
    return out


def flattened(df: DataFrame, paths: Sequence[str] | None = None) -> DataFrame:
    """Scalar fields by path, dots as underscores."""
    return df.select(*(F.col(p).alias(p.replace(".", "_")) for p in (paths or leaves(df.schema))))


def exploded(df: DataFrame, steps: Mapping[str, str]) -> DataFrame:
    """Arrays exploded one after another, outer, so parents without elements stay (N2). steps: path -> column name."""
    for path, name in steps.items():
        df = df.withColumn(name, F.explode_outer(path))
    return df


def compact(column: Column) -> Column:
    """An array without its nulls; of a null, an empty one."""
    return F.coalesce(F.array_compact(column), F.array().cast("array<string>"))


def present(column: Column) -> Column:
    """How many elements aren't null."""
    return F.size(compact(column))


def key_or(column: Column, key: str, default: str) -> Column:
    """A map's value, or the default: for a missing key, a null value, a null map."""
    return F.coalesce(F.try_element_at(column, F.lit(key)), F.lit(default))


def field_or(column: str, field: str, default: object) -> Column:
    """A struct's field, or the default; of a null struct too."""
    return F.coalesce(F.col(f"{column}.{field}"), F.lit(default))
