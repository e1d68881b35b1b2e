"""Joins (J1-J33)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash", "auto": None}


def join(left: DataFrame, right: DataFrame, keys: Sequence[str] | str | Column, how: str = "inner", strategy: str = "auto") -> DataFrame:
    """A join with its strategy as a hint on the right side, which leaves the session's settings alone.

    "auto" lets sizes decide; "broadcast" is for a right side that the caller knows is small.
    """
    hint = STRATEGIES[strategy]
    return left.join(right.hint(hint) if hint else right, [keys] if isinstance(keys, str) else keys, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """USING all columns of one name."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def self_join(df: DataFrame, key: str, parent: str, columns: Mapping[str, str], how: str = "left") -> DataFrame:
    """Rows with columns of the row that `parent` names (J9). columns: name there -> name here."""
    other = df.select(F.col(key).alias("_parent"), *(F.col(a).alias(b) for a, b in columns.items()))
    return df.join(other, F.col(parent) == F.col("_parent"), how).drop("_parent")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equal keys, null equal to null (J15); still a hash or merge join. Right's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def sentinel_join(left: DataFrame, right: DataFrame, keys: Sequence[str], sentinel: object, how: str = "inner") -> DataFrame:
    """Nulls replaced by a sentinel on both sides (J16). A key equal to the sentinel meets nulls: null_safe_join has no such case."""
    put = lambda df: df.withColumns({k: F.coalesce(F.col(k), F.lit(sentinel)) for k in keys})
    return put(left).join(put(right), list(keys), how)


def prepare_keys(df: DataFrame, keys: Sequence[str], strategy: str = "filter", sentinel: object = -999) -> DataFrame:
    """Null keys filtered, replaced, or left."""
    if strategy == "filter":
        return df.dropna(subset=list(keys))
    if strategy == "replace":
        return df.withColumns({k: F.coalesce(F.col(k), F.lit(sentinel).cast(df.schema[k].dataType)) for k in keys})
    if strategy == "none":
        return df
    raise ValueError(f"strategy is filter, replace or none, not {strategy!r}")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """low <= value <= high (J14) as an equality join on bins of a width, so no nested loop; null bounds never match.

    A range is copied to each bin it touches, a point is in one, so a pair is met once. width should be about the
    common length of the ranges. Points may be kept without a range (left); the copies of ranges can't.
    """
    if how not in ("inner", "left"):
        raise ValueError("ranges are copied to bins, which makes sense for inner and left joins only")
    spans = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    dots = points.withColumn("_bin", F.floor(F.col(value) / width))
    on = (dots["_bin"] == spans["_bin"]) & (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    return dots.join(spans.filter(F.col(low) <= F.col(high)), on, how).drop("_bin")


def pair_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Both rows as structs left and right (J18). on refers to aliases l and r."""
    joined = left.alias("l").join(right.alias("r"), on, how)
    return joined.select(F.struct("l.*").alias("left"), F.struct("r.*").alias("right"))


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str]], strategy: str = "auto", how: str = "inner") -> DataFrame:
    """A fact with its dimensions, each by a key of one name (J19-J21, J29). Put the most selective first.

    The strategy is for all of them; "auto" broadcasts those whose size allows it.
    """
    return reduce(lambda df, d: join(df, d[0], d[1], how, strategy), dimensions, fact)


def co_partitioned_join(left: DataFrame, right: DataFrame, keys: Sequence[str], partitions: int | None = None, how: str = "inner") -> DataFrame:
    """Both sides dealt by the keys alike (J26), to `partitions` or as many as the session says."""
    number = [partitions] if partitions else []
    return left.repartition(*number, *keys).join(right.repartition(*number, *keys), list(keys), how)


def tidy_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Each name once (J33): keys as USING has them, right's other columns with a suffix where left has their name."""
    have = {c.lower() for c in left.columns} - {k.lower() for k in keys}
    return left.join(right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c.lower() in have}), list(keys), how)
