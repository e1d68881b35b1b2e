"""Gaps in time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_sum


def densified(df: DataFrame, by: Sequence[str], day: str, fill: dict[str, object]) -> DataFrame:
    """A row for each day from an entity's first to its last (M8), the values of new days filled.

    Days already there keep all their rows; `by` may be empty.
    """
    spans = df.groupBy(*by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")).filter("_lo is not null")
    days = spans.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(day))
    return days.join(df, [*by, day], "left").fillna(fill)


def densified_running(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """M8 with the running sum (M9)."""
    return densified(df, by, day, {value: 0}).withColumn("running", running_sum(value, by, day))


def forward_fill(value: str, by: Sequence[str], *order: str) -> Column:
    """The last value that isn't null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def backward_fill(value: str, by: Sequence[str], *order: str) -> Column:
    """The next value that isn't null (W19), in the order of the forward one, so that one sort does."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))


def neighbour_mean(value: str, by: Sequence[str], *order: str) -> Column:
    """A null between two values becomes their mean; runs of nulls stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.coalesce(F.col(value), (F.lag(value).over(w) + F.lead(value).over(w)) / 2)


def interpolated(value: str, by: Sequence[str], *order: str) -> Column:
    """Nulls on the line, by rows, between the values around them; the ends stay null."""
    w = Window.partitionBy(*by).orderBy(*order)
    row = F.row_number().over(w)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), row.alias("r")))
    low = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first(point, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.coalesce(F.col(value), low["v"] + (high["v"] - low["v"]) * F.try_divide(row - low["r"], high["r"] - low["r"]))


def gaps(df: DataFrame, by: Sequence[str], day: str, longest: int = 1) -> DataFrame:
    """Days since the row before, and whether that is a gap."""
    since = F.datediff(F.col(day), F.lag(day).over(Window.partitionBy(*by).orderBy(day)))
    return df.withColumn("gap_days", since).withColumn("is_gap", F.coalesce(F.col("gap_days") > longest, F.lit(False)))
