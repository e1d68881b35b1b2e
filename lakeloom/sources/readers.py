"""Sources (S3-S13, S16-S22)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def from_rows(spark: SparkSession, rows: Iterable[Sequence], schema: Sequence[str] | StructType | str) -> DataFrame:
    """Tuples with names (types inferred) or with a schema."""
    return spark.createDataFrame(list(rows), schema)


def from_dicts(spark: SparkSession, rows: Iterable[Mapping], schema: StructType | str | None = None) -> DataFrame:
    """Dicts; keys that a row lacks are null."""
    rows = list(rows)
    if schema is None:
        names = list(dict.fromkeys(k for r in rows for k in r))
        return spark.createDataFrame([Row(**{k: r.get(k) for k in names}) for r in rows])
    return spark.createDataFrame(rows, schema)


def from_rdd(rdd: RDD, schema: Sequence[str] | StructType | None = None) -> DataFrame:
    """An RDD of tuples or Rows."""
    return SparkSession.active().createDataFrame(rdd, schema)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True, sep: str = ",", **options: str) -> DataFrame:
    """CSV (S8). Without a schema the types are inferred, at the cost of one more pass."""
    reader = spark.read.options(**options)
    return reader.csv(path, schema=schema, header=header, sep=sep, inferSchema=schema is None)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines or, with multi_line, whole documents."""
    return spark.read.json(path, schema=schema, multiLine=multi_line)


def parse_json(df: DataFrame, column: str, schema: str | StructType | Column | None = None, sample: str | None = None) -> DataFrame:
    """A text column of JSON as a struct (S10): by a schema, or by that of one sample document."""
    kind = schema if schema is not None else F.schema_of_json(F.lit(sample))
    return df.withColumn(column, F.from_json(column, kind))


def json_strings(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """JSON documents in memory, their nested schema inferred."""
    return spark.read.json(spark.sparkContext.parallelize(list(texts)))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **properties: str) -> DataFrame:
    """A database table (S12), or in `partitions` ranges of a numeric column at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return reader.load()


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table."""
    return spark.read.table(name)


def numbers(spark: SparkSession, n: int, **columns: str) -> DataFrame:
    """0..n-1 with columns by SQL expressions of id."""
    return spark.range(n).selectExpr("id", *(f"{e} AS {k}" for k, e in columns.items()))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line."""
    return spark.read.text(path)


def lines_rdd(spark: SparkSession, path: str) -> RDD:
    """An RDD of lines."""
    return spark.sparkContext.textFile(path)


def whole_files_rdd(spark: SparkSession, path: str) -> RDD:
    """An RDD of (path, content) of each file."""
    return spark.sparkContext.wholeTextFiles(path)


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parallelized(spark: SparkSession, values: Iterable, slices: int | None = None) -> RDD:
    """An RDD of values; of nothing, an empty one."""
    values = list(values)
    return spark.sparkContext.parallelize(values, slices) if values else spark.sparkContext.emptyRDD()


def field_of(df: DataFrame, name: str) -> RDD:
    """One field of each row as an RDD (S21); select() does the same without leaving the JVM."""
    return df.select(name).rdd.map(lambda r: r[0])


def read_sequence_file(spark: SparkSession, path: str) -> RDD:
    """(key, value) pairs of a Hadoop sequence file."""
    return spark.sparkContext.sequenceFile(path)
