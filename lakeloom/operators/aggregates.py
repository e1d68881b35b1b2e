"""Aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    """The sum where the condition holds, else 0."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def mean_where(condition: Column, value: Column) -> Column:
    """The mean where the condition holds; null where it never does (A10)."""
    return F.avg(F.when(condition, value))


def weighted_score(column: Column, weights: Mapping[str, int]) -> Column:
    """Points by value, summed."""
    return F.sum(F.coalesce(*(F.when(column == v, w) for v, w in weights.items()), F.lit(0)))


def share_of_total(df: DataFrame, keys: Sequence[str], value: Column, name: str, digits: int = 2) -> DataFrame:
    """Sums by key and their percentage of all, without a trip to the driver."""
    return with_share(df.groupBy(*keys).agg(F.sum(value).alias(name)), name, f"{name}_pct", digits)


def with_share(df: DataFrame, value: str, name: str, digits: int = 2) -> DataFrame:
    """df with each value's percentage of the sum of all, which is one row and goes to all of them."""
    whole = df.agg(F.sum(value).alias("_all")).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").withColumn(name, ratio(F.col(value), F.col("_all"), 100, digits)).drop("_one", "_all")


def pivot_sum(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], value: Column, fill: float | None = None) -> DataFrame:
    """Sums by key and value, the values given, so that the schema is fixed and no job looks for them."""
    out = df.groupBy(*keys).pivot(column, list(values)).agg(F.sum(value))
    return out if fill is None else out.fillna(fill, subset=list(values))


def pivot_share(df: DataFrame, keys: Sequence[str], columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Each of the columns as a percentage of the row's sum."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))
    return df.select(*keys, *(ratio(F.coalesce(F.col(c), F.lit(0)), total, 100, digits).alias(f"{c}_pct") for c in columns))


def profit_metrics(lines: DataFrame, keys: Sequence[str], price: Column, discount: Column, quantity: Column, cost: Column, order: str) -> DataFrame:
    """Revenue, profit, margin, and the mean value by order and by line."""
    revenue = (price - discount) * quantity
    out = lines.groupBy(*keys).agg(F.sum(revenue).alias("revenue"), F.sum(revenue - cost * quantity).alias("profit"), F.count(F.lit(1)).alias("lines"), F.count_distinct(order).alias("orders"))
    return out.withColumns({"margin_pct": ratio(F.col("profit"), F.col("revenue"), 100, 2), "per_order": ratio(F.col("revenue"), F.col("orders"), 1, 2), "per_line": ratio(F.col("revenue"), F.col("lines"), 1, 2)})


def deduplicated(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first by the order, which must break all ties to be the same each time."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", row).filter("_row = 1").drop("_row")


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n over white-space separated words in lower case."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
