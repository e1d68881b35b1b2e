"""Set operations and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that are neither null nor empty."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()


def union(*frames: DataFrame, fill: bool = False) -> DataFrame:
    """Rows of all, by name (O4); with fill, columns that one lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=fill)
    return out


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def intersection_by_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows of a whose keys b has (O7); unlike INTERSECT, null meets nothing."""
    return a.join(b.select(*keys), list(keys), "left_semi").distinct()


def first_row(df: DataFrame, *order: Column) -> tuple | None:
    """The first row by an order (O3), or None; each task keeps one."""
    row = df.orderBy(*order).first() if order else df.first()
    return None if row is None else tuple(row)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """EXCEPT: distinct, null equal to null."""
    return a.subtract(b)


def anti(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a whose keys b hasn't; those with a null key stay."""
    return a.join(b, list(keys), "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return anti(a, b, keys).unionByName(anti(b, a, keys))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows (O2): each task keeps k, so nothing is sorted whole."""
    return df.orderBy(*order).limit(k)
