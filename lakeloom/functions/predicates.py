"""Predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted


def any_null(columns: Sequence[str]) -> Column:
    """A null in at least one column: an OR that starts from false."""
    return reduce(or_, (F.col(quoted(c)).isNull() for c in columns), F.lit(False))


def all_null(columns: Sequence[str]) -> Column:
    return reduce(and_, (F.col(quoted(c)).isNull() for c in columns), F.lit(True))


def all_present(columns: Sequence[str]) -> Column:
    return ~any_null(columns)


def null_count(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(quoted(c)).isNull().cast("int") for c in columns), F.lit(0))


def on_day(column: Column, day: Column) -> Column:
    """The same calendar day; the clock is the caller's."""
    return F.to_date(column) == F.to_date(day)


def age_days(column: Column, day: Column | None = None) -> Column:
    """Days from a column's day to `day`, today by the session's clock if not given (X11)."""
    return F.datediff(day if day is not None else F.current_date(), F.to_date(column))
