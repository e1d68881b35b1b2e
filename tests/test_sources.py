"""Sessions, sources, sinks and streams: each is written or made, read back, and where the plan matters the plan is read."""

import datetime as dt

import pytest
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lakeloom import session
from lakeloom.plans.diagnostics import plan_text, timed
from lakeloom.sources import readers, writers
from lakeloom.streaming import changes

PEOPLE = StructType([StructField("id", IntegerType()), StructField("name", StringType())])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_session_and_context(spark):
    other = session.session("other", spark_sql_shuffle_partitions="3")
    assert isinstance(other, SparkSession) and other.conf.get("spark.sql.adaptive.enabled") == "true"
    assert other.sparkContext is spark.sparkContext and session.context().parallelize([1, 2]).sum() == 3
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_views_and_sql(spark):
    session.register(spark, "/root/testdata/sf0.001", ("nation", "region"))
    assert spark.sql("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey").first().n == 25
    assert session.query(spark, "SELECT max(id) AS m FROM {t}", t=spark.range(5)).first().m == 4


def test_rows_and_dicts(spark):
    assert rows(readers.from_rows(spark, [(1, "a"), (2, None)], PEOPLE)) == [(1, "a"), (2, None)]
    assert readers.from_rows(spark, [(1, "a")], ["id", "name"]).schema["id"].dataType == LongType()
    df = readers.from_dicts(spark, [{"a": 1}, {"a": 2, "b": "x"}])
    assert df.columns == ["a", "b"] and sorted((r.a, r.b or "") for r in df.collect()) == [(1, ""), (2, "x")]
    assert rows(readers.from_dicts(spark, [{"id": 1, "name": "z"}], PEOPLE)) == [(1, "z")]


def test_rdds(spark):
    sc = spark.sparkContext
    assert rows(readers.from_rdd(sc.parallelize([(1, "a"), (2, "b")]), PEOPLE)) == [(1, "a"), (2, "b")]
    assert rows(readers.from_rdd(sc.parallelize([Row(id=1, name="q")]))) == [(1, "q")]
    assert readers.parallelized(spark, []).isEmpty() and readers.parallelized(spark, [1, 2, 3], 2).getNumPartitions() == 2
    assert sorted(readers.field_of(spark.range(3), "id").map(lambda x: x * 2).collect()) == [0, 2, 4]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three")
    assert sorted(readers.lines_rdd(spark, str(tmp_path)).collect()) == ["one", "three", "two"]
    assert rows(readers.read_lines(spark, str(tmp_path))) == [("one",), ("three",), ("two",)]
    assert sorted(t for _, t in readers.whole_files_rdd(spark, str(tmp_path)).collect()) == ["one\ntwo\n", "three"]
    assert sorted(r.content for r in readers.read_whole_files(spark, str(tmp_path)).collect()) == ["one\ntwo\n", "three"]


def test_sequence_file(spark, tmp_path):
    spark.sparkContext.parallelize([("a", 1), ("b", 2)]).saveAsSequenceFile(f"{tmp_path}/seq")
    assert sorted(readers.read_sequence_file(spark, f"{tmp_path}/seq").collect()) == [("a", 1), ("b", 2)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, 'say "x"'), (3, None)], PEOPLE)
    writers.write_csv(df, f"{tmp_path}/c", single_file=True)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert sorted((r.id, r.name or "") for r in readers.read_csv(spark, f"{tmp_path}/c", PEOPLE).collect()) == [(1, "a,b"), (2, 'say "x"'), (3, "")]
    inferred = readers.read_csv(spark, f"{tmp_path}/c")
    assert inferred.schema["id"].dataType == IntegerType() and inferred.count() == 3
    (tmp_path / "semi.csv").write_text("1;x\n2;y\n")
    assert rows(readers.read_csv(spark, f"{tmp_path}/semi.csv", PEOPLE, header=False, sep=";")) == [(1, "x"), (2, "y")]


def test_json(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"id": 1, "name": "a"}\n{"id": 2}\n')
    (tmp_path / "whole.json").write_text('[\n {"id": 1,\n "name": "a"}\n]')
    assert rows(readers.read_json(spark, f"{tmp_path}/lines.json", PEOPLE)) == [(1, "a"), (2, None)]
    assert rows(readers.read_json(spark, f"{tmp_path}/whole.json", multi_line=True)) == [(1, "a")]
    nested = readers.json_strings(spark, ['{"id": 1, "tags": ["x", "y"], "at": {"city": "B"}}'])
    assert nested.select("at.city", F.size("tags")).first() == ("B", 2)
    text = spark.createDataFrame([('{"k": 7}',), ("broken",)], "t string")
    assert [r.t.k if r.t else None for r in readers.parse_json(text, "t", "k int").collect()] == [7, None]
    assert readers.parse_json(text, "t", sample='{"k": 1}').first().t.k == 7


def test_parquet_overwrites(spark, tmp_path):
    writers.write_parquet(spark.range(5), f"{tmp_path}/p")
    writers.write_parquet(spark.range(3), f"{tmp_path}/p")
    assert readers.read_parquet(spark, f"{tmp_path}/p").count() == 3


def test_partitioned_scan_is_pruned(spark, tmp_path):
    """A filter on the partition column leaves one directory to read, one on a value reaches the files."""
    writers.write_parquet(spark.range(100).selectExpr("id", "id % 4 AS part", "id * 2 AS v"), f"{tmp_path}/p", partition_by=["part"], files_per_partition=2)
    df = readers.read_parquet(spark, f"{tmp_path}/p").filter("part = 3 and v > 100").select("id")
    text = plan_text(df)
    assert "PartitionFilters: [isnotnull(part" in text and "PushedFilters: [IsNotNull(v), GreaterThan(v,100)]" in text and "ReadSchema: struct<id:bigint,v:bigint>" in text
    assert df.count() == 13
    writers.save_table(spark.range(10).selectExpr("id", "id % 2 AS part"), "t_parted", partition_by=["part"])
    assert readers.read_table(spark, "t_parted").filter("part = 1").count() == 5
    spark.sql("DROP TABLE t_parted")


def test_bucketed_tables_join_without_a_shuffle(spark):
    """Two tables bucketed alike meet bucket by bucket; the same by DDL."""
    for name in ("b_left", "b_right"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    writers.save_table(spark.range(1000).selectExpr("id AS k", "id * 2 AS v"), "b_left", bucket_by=["k"], buckets=4)
    writers.save_table(spark.range(500).selectExpr("id AS k", "id + 1 AS w"), "b_right", bucket_by=["k"], buckets=4)
    joined = readers.read_table(spark, "b_left").hint("merge").join(readers.read_table(spark, "b_right"), "k")
    assert "Exchange" not in plan_text(joined) and "SortMergeJoin" in plan_text(joined)
    assert joined.count() == 500
    spark.sql("DROP DATABASE IF EXISTS made CASCADE")
    for name in ("x", "y"):
        writers.create_bucketed_table(spark.range(50).selectExpr("id AS k", "id AS v"), "made", name, ["k"], 3)
    both = spark.table("made.x").hint("merge").join(spark.table("made.y"), "k")
    assert "Exchange" not in plan_text(both) and both.count() == 50
    spark.sql("DROP DATABASE made CASCADE")
    for name in ("b_left", "b_right"):
        spark.sql(f"DROP TABLE {name}")


def test_jdbc(spark, tmp_path):
    """A database in memory, read whole and in ranges of a column at once."""
    url = "jdbc:derby:memory:shop;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("CAST(id AS INT) AS k", "id * 3 AS v").write.format("jdbc").options(url=url, dbtable="sales", driver=driver).mode("overwrite").save()
    assert readers.read_jdbc(spark, url, "sales", driver=driver).count() == 100
    parts = readers.read_jdbc(spark, url, "sales", "k", 0, 100, 4, driver=driver)
    assert parts.rdd.getNumPartitions() == 4 and parts.agg(F.sum("v")).first()[0] == 3 * 4950


def test_actions(spark, capsys):
    df = spark.range(10)
    df.show(2)
    df.printSchema()
    assert "only showing top 2 rows" in capsys.readouterr().out
    assert timed(df)[0] == 10 and df.take(2)[1].id == 1 and df.first().id == 0 and len(df.collect()) == 10


HISTORY = "user string, plan string, effective_from timestamp, effective_to timestamp, is_current boolean"


def test_history_from_a_stream(spark, tmp_path):
    """Two batches, the second of them read twice over; the history equals that of one batch with all changes."""
    from lakeloom.operators import merge

    day = lambda n: dt.datetime(2024, 1, n)
    first = spark.createDataFrame([("a", "free", day(1), day(2), False), ("a", "basic", day(2), None, True), ("b", "pro", day(1), None, True)], HISTORY)
    changes.start_history(first, f"{tmp_path}/h")
    kind = "user string, plan string, at timestamp"
    batches = [[("a", "pro", day(3)), ("c", "free", day(3)), ("b", "late", day(1))], [("a", "max", day(5)), ("c", "free", day(6)), ("b", "basic", day(7))]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        changes.maintain_history(stream, f"{tmp_path}/h", f"{tmp_path}/check", "user", ["plan"], "at").awaitTermination(120)
        key = ["user", "plan", "effective_from", "effective_to", "is_current"]
        got = changes.read_history(spark, f"{tmp_path}/h", n + 1).select(*key)
        want = merge.scd2(first, spark.createDataFrame([r for b in batches[: n + 1] for r in b], kind), "user", ["plan"], "at").select(*key)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_windowed_counts_of_a_stream(spark, tmp_path):
    kind = "ts timestamp, kind string"
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    events = [(at(1, 5), "x"), (at(1, 50), "x"), (at(2, 1), "y"), (at(9, 0), "x")]
    spark.createDataFrame(events, kind).coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = changes.windowed_counts(spark.readStream.schema(kind).parquet(f"{tmp_path}/e"), "ts", ["kind"])
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.start.hour, r.kind, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "x", 2), (2, "y", 1)]
    assert sorted((r.start.hour, r.kind, r.n) for r in changes.windowed_counts(spark.createDataFrame(events, kind), "ts", ["kind"]).collect()) == [*got, (9, "x", 1)]


@pytest.mark.parametrize("name", ["lakeloom.session", "lakeloom.sources.readers", "lakeloom.streaming.changes", "__spark_entry__"])
def test_imports(name):
    __import__(name)
