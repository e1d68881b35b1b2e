"""Null toolkit, rules and schemas (Q1-Q15, Q18, Q20)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import quoted, ratio
from ..functions.predicates import null_count
from .aggregates import with_share
from .windows import quantile


def null_counts(df: DataFrame) -> DataFrame:
    """One row, the nulls of each column (Q1)."""
    return df.agg(*(F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in df.columns))


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls, null_pct in one pass (Q2); of an empty table, no percentage."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(quoted(c)).isNull()).alias(f"_c{i}") for i, c in enumerate(df.columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("nulls")) for i, c in enumerate(df.columns)))
    return sums.select("_n", F.inline(pairs)).select("column", "nulls", ratio(F.col("nulls"), F.col("_n"), 100, 2).alias("null_pct"))


def sparse_columns(df: DataFrame, percent: float = 5.0) -> list[str]:
    """Names of columns with a higher share of nulls (Q3): as many values as columns come to the driver."""
    return [r["column"] for r in null_profile(df).filter(F.col("null_pct") > percent).collect()]


def without_sparse_columns(df: DataFrame, percent: float = 40.0) -> DataFrame:
    return df.drop(*sparse_columns(df, percent))


def rows_with_few_nulls(df: DataFrame, most: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with at most so many nulls in columns (Q5)."""
    return df.filter(null_count(columns or df.columns) <= most)


def dropped_nulls(df: DataFrame, how: str = "any", columns: Sequence[str] | None = None, least: int | None = None) -> DataFrame:
    """dropna: any, all, of some columns, or with fewer than `least` values (Q6)."""
    return df.dropna(how=how, subset=list(columns) if columns else None, thresh=least)


def filled(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Nulls by column (Q7), dates and timestamps too."""
    return df.withColumns({c: F.coalesce(F.col(quoted(c)), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def filled_where(df: DataFrame, column: str, *branches: tuple[Column, object]) -> DataFrame:
    """Nulls by what other columns say (Q8)."""
    return df.withColumn(column, F.coalesce(F.col(column), *(F.when(p, v) for p, v in branches)))


def imputed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Nulls as the column's mean, median or mode (Q9): one row of statistics, joined on. No task holds a column's values for its median."""
    make = {"mean": F.avg, "mode": F.mode}
    stats = df.agg(F.count(F.lit(1)).alias("_rows"), *(make[how](c).alias(f"_s_{c}") for c, how in columns.items() if how != "median")).withColumn("_one", F.lit(1))
    for c, how in columns.items():
        if how == "median":
            stats = stats.join(F.broadcast(quantile(df, c).select(F.col("q").alias(f"_s_{c}"), F.lit(1).alias("_one"))), "_one")
    one = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats.drop("_rows")), "_one")
    return one.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_s_{c}").cast("double")) for c in columns}).drop("_one", *(f"_s_{c}" for c in columns))


def imputed_by_model(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> DataFrame:
    """The same by an estimator that is fitted once and can be kept (Q10)."""
    from pyspark.ml.feature import Imputer

    return Imputer(inputCols=list(columns), outputCols=list(columns), strategy=strategy).fit(df).transform(df)


def null_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, whether the columns hold no null (Q12)."""
    return df.agg((F.coalesce(F.max(null_count(columns)), F.lit(0)) == 0).alias("no_nulls"))


def has_no_nulls(df: DataFrame, columns: Sequence[str]) -> bool:
    return null_check(df, columns).first()[0]


def null_impact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows, complete, lost_pct (Q13)."""
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(null_count(columns or df.columns) == 0).alias("complete"))
    return out.withColumn("lost_pct", ratio(F.col("rows") - F.col("complete"), F.col("rows"), 100, 2))


def ruled(df: DataFrame, rules: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """Rules by column (Q14): where the test holds the value stays, else (null too) it becomes the default; has_invalid tells.

    A rule that a null makes unknown counts as broken, so the flag is never null.
    """
    ok = {c: F.coalesce(test, F.lit(False)) for c, (test, _) in rules.items()}
    flag = F.lit(False)
    for test in ok.values():
        flag = flag | ~test
    fixed = {c: F.when(ok[c], F.col(c)).otherwise(default if isinstance(default, Column) else F.lit(default)) for c, (_, default) in rules.items()}
    return df.withColumns(fixed | {"has_invalid": flag})


def conformed(df: DataFrame, target: StructType, names: Mapping[str, str] | None = None) -> DataFrame:
    """df in the shape of target (Q15): renamed, without case, cast (null where a value doesn't fit), completed, reordered, extra columns dropped."""
    df = df.withColumnsRenamed(dict(names or {}))
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(quoted(have[f.name.lower()])).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target))


def conformed_union(target: DataFrame, *others: DataFrame) -> DataFrame:
    out = target
    for df in others:
        out = out.unionByName(conformed(df, target.schema))
    return out


def status_summary(df: DataFrame, status: str) -> DataFrame:
    """Rows by status with their percentage (Q18)."""
    return with_share(df.groupBy(status).agg(F.count(F.lit(1)).alias("rows")), "rows", "pct")


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, the null or blank values of text columns (Q20)."""
    return df.agg(*(F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(c) for c in columns), F.count(F.lit(1)).alias("rows"))
