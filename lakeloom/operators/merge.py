"""Incremental loads (M1-M7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import deduplicated


def same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], *order: Column, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of a batch whose keys (M2: all of them, null equal to null) target hasn't, one for each key (M1)."""
    batch = batch.withColumns({c: F.coalesce(F.col(c), v) for c, v in (defaults or {}).items()})
    batch = deduplicated(batch, keys, *(order or [F.col(c) for c in batch.columns]))
    return batch.alias("b").join(target.select(*keys).alias("t"), same("b", "t", keys), "left_anti")


def append_new(target: DataFrame, batch: DataFrame, keys: Sequence[str], *order: Column, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    return target.unionByName(new_rows(target, batch, keys, *order, defaults=defaults))


def scd1(target: DataFrame, batch: DataFrame, key: str, keep: Sequence[str], stamp: str, now: Column, *order: Column) -> DataFrame:
    """Type 1 (M3): new values replace old ones, columns in keep stay as they were first, and change says what happened.

    One full outer join. The clock is the caller's. Of several rows of a batch for one key the first by `order` counts
    (without it, the largest by all columns), so a key stays one row.
    """
    batch = deduplicated(batch, [key], *(order or [F.desc(c) for c in batch.columns]))
    old, new = target.alias("o"), batch.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there, here = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    change = F.when(there & here, "updated").when(there, "unchanged").otherwise("inserted")
    out = []
    for c in target.columns:
        if c == stamp:
            out.append(F.when(here, now).otherwise(F.col(f"o.{c}")).alias(c))
        elif c == key:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in keep:
            first = F.col(f"n.{c}") if c in batch.columns else now.cast(target.schema[c].dataType)
            out.append(F.when(there, F.col(f"o.{c}")).otherwise(first).alias(c))
        else:
            out.append(F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out, change.alias("change"))


def change_counts(merged: DataFrame) -> DataFrame:
    """updated, unchanged, inserted, total in one row (M4)."""
    return merged.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("updated", "unchanged", "inserted")), F.count(F.lit(1)).alias("total"))


def classified(history: DataFrame, changes: DataFrame, key: str, attributes: Sequence[str], stamp: str) -> DataFrame:
    """Changes with what they are against the current version (M5, M6): NEW, OUTDATED, NO_CHANGE or VALID, asked in this order.

    A change from before the current version's start is OUTDATED even if it says the same; one at its very start isn't.
    """
    current = history.filter("is_current").alias("h")
    joined = changes.distinct().alias("c").join(current, F.col(f"c.{key}") == F.col(f"h.{key}"), "left")
    what = F.when(F.col(f"h.{key}").isNull(), "NEW").when(F.col(f"c.{stamp}") < F.col("h.effective_from"), "OUTDATED").when(same("c", "h", attributes), "NO_CHANGE").otherwise("VALID")
    return joined.select("c.*", what.alias("decision"))


def scd2(history: DataFrame, changes: DataFrame, key: str, attributes: Sequence[str], stamp: str, late: str = "skip") -> DataFrame:
    """Type 2 (M5): versions of a key in order of time, each open until the next.

    Known versions and changes are put in one order; one that says the same as the one before is dropped; ends follow from the
    next start. So a batch may hold many changes of a key, in any order, and running it again changes nothing.
    late: "skip" drops changes that aren't after the key's current version, "merge" puts them where they belong.
    """
    columns = [key, *attributes]
    known = history.select(*columns, "effective_from", F.lit(0).alias("_source"))
    more = changes.filter(F.col(key).isNotNull() & F.col(stamp).isNotNull()).select(*columns, F.col(stamp).alias("effective_from"), F.lit(1).alias("_source")).distinct()
    if late == "skip":
        current = history.filter("is_current").groupBy(key).agg(F.max("effective_from").alias("_since"))
        more = more.join(current, key, "left").filter("_since is null or effective_from > _since").drop("_since")
    elif late != "merge":
        raise ValueError(f"late is skip or merge, not {late!r}")
    by_key = Window.partitionBy(key)
    order = by_key.orderBy("effective_from", "_source", *attributes)
    rows = known.unionByName(more)
    # of several changes at one instant the last stays; a known version stands before them. One order for all windows: one shuffle and sort.
    rows = rows.withColumn("_next", F.lead("effective_from").over(order)).filter("_source = 0 or _next is null or _next <> effective_from").drop("_next")
    state = F.struct(*attributes)
    rows = rows.withColumn("_before", F.lag(state).over(order)).filter((F.col("_source") == 0) | F.col("_before").isNull() | ~state.eqNullSafe(F.col("_before"))).drop("_before")
    until = F.lead("effective_from").over(order)
    out = rows.withColumn("effective_to", until).drop("_source")
    return out.withColumn("is_current", F.col("effective_to").isNull())


def current_per_key(history: DataFrame, key: str) -> DataFrame:
    """Keys that don't have exactly one current version (M7): none, if all is well."""
    return history.groupBy(key).agg(F.count_if("is_current").alias("current")).filter("current <> 1")
