"""What joins meet and what plans do."""

from __future__ import annotations

import contextlib
import io
import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.predicates import any_null


def key_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, null_keys, null_pct, distinct_keys in one pass."""
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_null(keys)).alias("null_keys"), F.count_distinct(*keys).alias("distinct_keys"))
    return out.withColumn("null_pct", ratio(F.col("null_keys"), F.col("rows"), 100, 2))


def join_size(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows an inner join makes, from counts by key, without making them."""
    a = left.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    b = right.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, list(keys)).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("rows"), F.coalesce(F.max(F.col("_a") * F.col("_b")), F.lit(0)).alias("most_of_a_key"))


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What explain() prints."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(mode)
    return out.getvalue()


def join_strategies(df: DataFrame) -> list[str]:
    """The kinds of joins of the physical plan, as they come."""
    kinds = "BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct"
    return re.findall(rf"^[\s:+*|-]*(?:\(\d+\) )?({kinds})", plan_text(df, "simple"), re.M)


def timed(df: DataFrame) -> tuple[int, float]:
    """(rows, seconds) of a full run."""
    began = time.perf_counter()
    n = df.count()
    return n, time.perf_counter() - began
