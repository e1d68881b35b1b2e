"""Sinks (S14-S16, S25)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False, header: bool = True) -> None:
    """CSV (S14). single_file makes one task write everything: for small results only."""
    (df.coalesce(1) if single_file else df).write.csv(path, mode=mode, header=header)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), files_per_partition: int | None = None) -> None:
    """Parquet (S15), partitioned by columns.

    Rows are brought to their partitions first, so a task opens few files; a partition that holds much is dealt to
    files_per_partition tasks, and skewed ones are split when rebalanced.
    """
    if partition_by:
        df = df.repartition(files_per_partition, *partition_by) if files_per_partition else df.hint("rebalance", *partition_by)
    df.write.parquet(path, mode=mode, partitionBy=list(partition_by) or None)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int = 0, sort_by: Sequence[str] = ()) -> None:
    """A catalog table, partitioned (S16) or bucketed (S25): two tables bucketed alike join without a shuffle."""
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by[0], *bucket_by[1:]).sortBy(*(sort_by or bucket_by))
    writer.saveAsTable(name)


def create_bucketed_table(df: DataFrame, database: str, name: str, keys: Sequence[str], buckets: int) -> None:
    """The same by DDL: CREATE DATABASE, CREATE TABLE ... CLUSTERED BY, INSERT."""
    spark = df.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({fields}) USING parquet CLUSTERED BY ({', '.join(f'`{k}`' for k in keys)}) INTO {buckets} BUCKETS")
    df.write.mode("append").insertInto(f"{database}.{name}")
