"""Window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def top_n(df: DataFrame, by: Sequence[str], *order: Column, n: int = 1, ties: str = "row_number") -> DataFrame:
    """The first n of each group (W4): of rows, or with ties "rank" / "dense_rank". Cut before the shuffle (WindowGroupLimit)."""
    number = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[ties]()
    return df.withColumn("position", number.over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("position") <= n)


def ranks(df: DataFrame, by: Sequence[str], *order: Column, tiebreak: Sequence[Column] = ()) -> DataFrame:
    """row_number (with the tiebreak), rank and dense_rank."""
    over = Window.partitionBy(*by).orderBy(*order)
    full = Window.partitionBy(*by).orderBy(*order, *tiebreak)
    return df.withColumns({"row_number": F.row_number().over(full), "rank": F.rank().over(over), "dense_rank": F.dense_rank().over(over)})


def banded(df: DataFrame, name: str, *order: str, bands: int = 0) -> DataFrame:
    """df with the number of a band of rows in ascending order of columns; bands follow one another.

    Their edges are values of a few dozen rows a band (those of the smallest hashes), which come to the driver once and
    stand in the plan as literals, so every evaluation cuts alike.
    """
    bands = bands or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    some = sorted((tuple((x is not None, x) for x in r) for r in keys.orderBy(F.xxhash64(*keys.columns)).limit(bands * 32).collect()), key=lambda r: tuple((there, x if there else 0) for there, x in r))
    edges = [some[len(some) * i // bands] for i in range(1, bands)] if some else []
    point = F.struct(*(c.alias(f"f{j}") for j, c in enumerate(y for k in order for y in (F.col(k).isNotNull(), F.col(k)))))
    if not edges:
        return df.withColumn(name, F.lit(0))
    kinds = [df.schema[k].dataType for k in order]
    edge = [F.struct(*(c.alias(f"f{j}") for j, c in enumerate(y for (there, x), t in zip(e, kinds, strict=True) for y in (F.lit(there), F.lit(x).cast(t))))) for e in dict.fromkeys(edges)]
    return df.withColumn(name, F.size(F.filter(F.array(*edge), lambda e: e <= point)))


def numbered(df: DataFrame, name: str, *order: str, bands: int = 0) -> DataFrame:
    """df with the number of each row, from 1, in ascending order of columns (nulls first), without one task for all rows.

    Rows are numbered inside bands; the counts of the bands before, a row for each, are added.
    """
    rows = banded(df, "_band", *order, bands=bands)
    counts = rows.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_band").orderBy(*order)))
    # a row for each band: their number is the caller's or the session's
    return inside.join(F.broadcast(counts.select("_band", earlier.alias("_before"))), "_band").withColumn(name, F.col("_i") + F.col("_before")).drop("_band", "_i", "_before")


def global_rank(df: DataFrame, order: Column, name: str = "position", bands: int = 0) -> DataFrame:
    """dense_rank over all rows (W5) without one task for all of them: numbers of the distinct values, joined back."""
    values = numbered(df.select(order.alias("_v")).distinct(), name, "_v", bands=bands)
    return df.withColumn("_w", order).join(values, F.col("_w").eqNullSafe(F.col("_v"))).drop("_v", "_w")


def quantile(df: DataFrame, column: str, share: float = 0.5, bands: int = 0) -> DataFrame:
    """The exact quantile of a column, as one row `q` (null for no values), between two values where it falls between them.

    Values are counted first, then banded; only the band that holds the place is put in order.
    """
    counts = banded(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "_band", "_v", bands=bands)
    # as many rows as bands come to the driver
    sums = sorted(tuple(r) for r in counts.groupBy("_band").agg(F.sum("_n")).collect())
    total = sum(n for _, n in sums)
    place = share * (total - 1)
    low, high = int(place), min(int(place) + 1, max(total - 1, 0))
    before, found = 0, {}
    for band, n in sums:
        for k in (low, high):
            if before <= k < before + n:
                found[k] = (band, before)
        before += n
    if not total:
        return df.agg(F.max(F.lit(None).cast("double")).alias("q"))
    own = counts.filter(F.col("_band").isin(sorted({b for b, _ in found.values()})))
    until = F.sum("_n").over(Window.partitionBy("_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.create_map(*(F.lit(x) for b, s in sorted(set(found.values())) for x in (b, s)))
    own = own.withColumn("_until", until + start[F.col("_band")])
    at = lambda k: F.min(F.when(F.col("_until") > k, F.col("_v"))).cast("double")
    return own.agg((at(low) + (at(high) - at(low)) * (place - low)).alias("q"))


def tie_stats(df: DataFrame, by: Sequence[str], value: str, tiebreak: str) -> DataFrame:
    """Rows, distinct values, rows in ties and their percentage, by group."""
    ranked = ranks(df, by, F.col(value).desc(), tiebreak=[F.col(tiebreak)])
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(value).alias("values"), F.count_if(F.col("rank") != F.col("row_number")).alias("tied"))
    return out.withColumn("tied_pct", ratio(F.col("tied"), F.col("rows"), 100, 2))


def rank_disagreement(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """First by a but not by b."""
    w = Window.partitionBy(*by)
    both = df.withColumns({"rank_a": F.dense_rank().over(w.orderBy(F.desc(a))), "rank_b": F.dense_rank().over(w.orderBy(F.desc(b)))})
    return both.filter("rank_a = 1 and rank_b > 1")


def running_sum(value: str, by: Sequence[str], *order: str) -> Column:
    """From the first row to this one."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def rolling_rows(value: str, by: Sequence[str], n: int, *order: str) -> Column:
    """Over the last n rows."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, Window.currentRow))


def rolling_days(value: str, by: Sequence[str], n: int, day: str) -> Column:
    """Over the last n calendar days."""
    ordinal = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return F.sum(value).over(Window.partitionBy(*by).orderBy(ordinal).rangeBetween(1 - n, Window.currentRow))


def growth(value: str, by: Sequence[str], *order: str, digits: int = 2) -> Column:
    """Percentage over the row before; null for the first and over 0."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return ratio(F.col(value) - before, before, 100, digits)


def timeline(df: DataFrame, by: Sequence[str], value: str, when: str) -> DataFrame:
    """Previous, next and first value with the gaps between, over one window."""
    w = Window.partitionBy(*by).orderBy(when)
    before, after, first = F.lag(value).over(w), F.lead(value).over(w), F.first_value(value).over(w)
    trend = F.when(before.isNull(), "first").when(F.col(value) > before, "up").when(F.col(value) < before, "down").otherwise("same")
    return df.withColumns({"previous": before, "following": after, "first": first, "trend": trend, "gap_days": F.datediff(F.col(when), F.lag(when).over(w)), "from_first": F.col(value) - first})


def compared(value: Column, other: Column, more: str, less: str, same: str, none: str) -> Column:
    """A label for how a value stands to another; `none` where there is no other."""
    return F.when(other.isNull(), none).when(value > other, more).when(value < other, less).otherwise(same)


def pace(days: Column, *steps: tuple[int, str], otherwise: str, none: str) -> Column:
    """A label for a number of days: that of the first step that holds it; steps rise."""
    out = F.when(days.isNull(), none)
    for most, label in steps:
        out = out.when(days <= most, label)
    return out.otherwise(otherwise)
