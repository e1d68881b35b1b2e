"""Sessions and the tables and views of a folder of Parquet files."""

from __future__ import annotations

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "lakeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a fixed time zone; conf keys may write _ for a dot."""
    builder = SparkSession.builder.appName(name).config(conf=SparkConf())
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def context(name: str = "lakeloom", **conf: str) -> SparkContext:
    """The session's context, or a new one."""
    return SparkContext.getOrCreate(SparkConf().setAppName(name).setAll([(k.replace("_", "."), v) for k, v in conf.items()]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables in folder."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """SQL over frames by name, without views that outlive the call."""
    return spark.sql(sql, **frames)
