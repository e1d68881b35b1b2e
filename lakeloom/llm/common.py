"""What the operators of this subpackage share: tables, the shared scratch folder, and words as bytes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one Python step holds as objects at a time.
ROWS_AT_ONCE = 256
#: Characters that one Python step holds as objects at a time (one longer text is held alone).
CHARS_AT_ONCE = 8_000_000


def ship(spark: SparkSession) -> None:
    """Gives workers this package, wherever they run: a zip of it, once for each application."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if getattr(sc, "_lakeloom_shipped", False) or not package.is_dir():
        return
    place = Path(tempfile.mkdtemp(prefix="lakeloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(place, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(place))
    sc._lakeloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, one made here where none is named."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the application ends, as results may read it until then."""
    path = f"{shared_folder(spark)}/lakeloom/{name}-{uuid.uuid4().hex}"
    fs, place = hadoop(spark, path)
    fs.deleteOnExit(place)
    return path


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, for the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that nothing reads any more."""
    fs, place = hadoop(spark, path)
    fs.delete(place, True)


def crc32_of(column: str) -> Column:
    """crc32 of a column's text form, as a long."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case. bytes.split() parts at exactly the white space that WORD names."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pieces(batches: Iterator[pa.RecordBatch], text: int | str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut by rows and by the size of a column, so that what Python holds at once doesn't grow with the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text) if text is not None else None
        step = ROWS_AT_ONCE
        if column is not None and column.nbytes:
            step = max(1, min(ROWS_AT_ONCE * 16, batch.num_rows * CHARS_AT_ONCE // max(1, column.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
