"""Streams into the batch operators: type-2 history from a stream of changes, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import scd2


def start_history(history: DataFrame, path: str) -> None:
    """Lays a history (key, attributes, effective_from, effective_to, is_current) down where maintain_history() keeps it."""
    history.filter("not is_current").write.mode("overwrite").parquet(f"{path}/closed/batch=-1")
    history.filter("is_current").write.mode("overwrite").parquet(f"{path}/current/v0")


def read_history(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """The history after so many batches: what was closed until then, and the versions that are current."""
    closed = spark.read.option("basePath", f"{path}/closed").parquet(f"{path}/closed").filter(F.col("batch") < batches).drop("batch")
    return closed.unionByName(spark.read.parquet(f"{path}/current/v{batches}"))


def maintain_history(changes: DataFrame, path: str, checkpoint: str, key: str, attributes: Sequence[str], stamp: str, **trigger: object) -> StreamingQuery:
    """Keeps the history in path up to date with a stream of changes; late ones are skipped.

    A closed version never changes again, so a batch reads and rewrites the current ones only, a row for each key, and adds
    what it closes. Each batch writes under its own number, so one that is run again gives the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        current = batch.sparkSession.read.parquet(f"{path}/current/v{number}")
        out = scd2(current, batch, key, attributes, stamp).select(*current.columns).persist()
        out.filter("not is_current").write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        out.filter("is_current").write.mode("overwrite").parquet(f"{path}/current/v{number + 1}")
        out.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, when: str, by: Sequence[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and key, late ones until the watermark passes."""
    rows = events.withWatermark(when, delay) if events.isStreaming else events
    out = rows.groupBy(F.window(when, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n")
