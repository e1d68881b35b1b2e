"""Small tables with known results, and properties of the merges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import columns as C
from lakeloom.functions import predicates as P
from lakeloom.operators import cleaning, joins, merge, quality, setops, skew, timeseries
from lakeloom.operators import windows as W
from lakeloom.plans import diagnostics


def test_row_with_any_null_is_found_and_a_complete_one_is_not(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert [r.id for r in df.filter(P.any_null(["id", "v"])).collect()] == [2]
    assert [r.id for r in df.filter(P.all_present(["id", "v"])).collect()] == [1]


def test_null_keys_meet_only_in_a_null_safe_join(spark):
    a = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, k int")
    b = spark.createDataFrame([(10, "x"), (None, "y")], "k int, v string")
    assert joins.join(a, b, "k").count() == 1
    assert joins.null_safe_join(a, b, ["k"]).count() == 2
    assert joins.join(a, b, "k", "left_anti").count() == 2


def test_range_join_equals_nested_loop(spark):
    points = spark.range(200).selectExpr("id", "id * 7 % 100 AS v")
    ranges = spark.createDataFrame([(1, 5, 20), (2, None, 30), (3, 90, 140), (4, 50, 50)], "r int, lo int, hi int")
    want = points.join(ranges, F.col("v").between(F.col("lo"), F.col("hi"))).select("id", "r")
    got = joins.range_join(points, ranges, "v", "lo", "hi", 8).select("id", "r")
    assert sorted(want.collect()) == sorted(got.collect())


def test_range_join_refuses_to_repeat_ranges(spark):
    points, ranges = spark.range(3).selectExpr("id AS v"), spark.createDataFrame([(1, 0, 50), (2, None, 3)], "r int, lo int, hi int")
    assert joins.range_join(points, ranges, "v", "lo", "hi", 4, "left").count() == 3
    for how in ("right", "full", "left_anti"):
        with pytest.raises(ValueError):
            joins.range_join(points, ranges, "v", "lo", "hi", 4, how)


def test_joined_names_stay_apart(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y", 2)], "k int, V string, w int")
    out = joins.tidy_join(a, b, ["k"])
    assert out.columns == ["k", "v", "V_right", "w"] and tuple(out.first()) == (1, "x", "y", 2)
    assert C.distinct_names(a.select("v", "k", "v")).columns == ["v", "k", "v_2"]
    assert C.missing(a, ["K", "z"]) == ["z"]


def test_rows_are_numbered_in_bands(spark):
    rows = [(i, None if i % 10 == 0 else i * 7 % 13, f"n{i % 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v int, s string")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    for bands in (1, 4, 50):
        got = [r.i for r in W.numbered(df, "n", "v", "s", "i", bands=bands).orderBy("n").collect()]
        assert got == [r[0] for r in want]
    assert W.numbered(df.limit(0), "n", "v").count() == 0
    ranks = {r.i: r.position for r in W.global_rank(df, F.col("v"), bands=5).collect()}
    place = {v: k for k, v in enumerate([None, *range(13)], 1)}
    assert ranks == {i: place[v] for i, v, _ in rows}


def test_quantiles(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, None, 1.0, 9.0], [2.0] * 50 + [7.0] * 50, [float(i * 37 % 101) for i in range(101)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert W.quantile(df, "v", bands=6).first().q == df.agg(F.median("v")).first()[0]
        assert W.quantile(df, "v", 0.9, bands=3).first().q == pytest.approx(df.agg(F.expr("percentile(v, 0.9)")).first()[0])
    assert W.quantile(spark.createDataFrame([(None,)], "v double"), "v").first().q is None


def test_imputers(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, None, 6.0), (3, 3.0, None), (4, 8.0, 6.0)], "k int, a double, b double")
    out = quality.imputed(df, {"a": "median", "b": "mode"}).orderBy("k").collect()
    assert [r.a for r in out] == [1, 3, 3, 8] and [r.b for r in out] == [4, 6, 6, 6]
    assert [r.a for r in quality.imputed_by_model(df, ["a"], "mean").orderBy("k").collect()] == [1, 4, 3, 8]
    assert quality.has_no_nulls(df, ["k"]) and not quality.has_no_nulls(df, ["k", "a"]) and quality.has_no_nulls(df.limit(0), ["a"])


def test_first_row(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    assert setops.first_row(df, F.col("k")) == (1, "a") and setops.first_row(df.limit(0)) is None


def test_salted_joins_agree_with_the_plain_one(spark):
    fact = spark.range(2_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 40 END AS k")
    other = spark.range(45).selectExpr("id AS k", "id * 2 AS v").filter("k <> 11")
    for how in ("inner", "left"):
        want = sorted(map(str, fact.join(other, "k", how).select("id", "k", "v").collect()))
        for most in (50, 1):
            assert sorted(map(str, skew.salted_join(fact, other, "k", 30, 4, how, most).select("id", "k", "v").collect())) == want
    salted = skew.random_salt(fact, 4, 42)
    assert {r.salt for r in salted.collect()} == {0, 1, 2, 3}
    assert sorted(map(str, salted.collect())) == sorted(map(str, skew.random_salt(fact, 4, 42).collect()))


def test_salted_fact_is_not_dealt_by_its_skewed_key(spark):
    fact = spark.range(2_000).selectExpr("id", "IF(id % 3 = 0, 7, id % 40) AS k")
    text = diagnostics.plan_text(skew.salted_join(fact, spark.range(45).selectExpr("id AS k"), "k", 100, 4).hint("merge"))
    assert "BroadcastExchange" in text


ADDRESSES = {"a@b.co": True, "first.last+tag@mail.example.org": True, "A_%-1@x-y.io": True, "a@b": False, "a@.co": False, "a@b..co": False, "@b.co": False, "a b@c.de": False, "a@b.c": False, "a@b.c1": False, "é@b.co": False, "a@b.co ": False}


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    assert {r.a: r.ok for r in df.select("a", F.col("a").rlike(cleaning.EMAIL).alias("ok")).collect()} == ADDRESSES


def test_surrogate_ids(spark):
    df = spark.createDataFrame([(1, "S150"), (2, None), (3, " "), (4, "S7"), (5, None)], "k int, sid string")
    assert [(r.k, r.sid) for r in cleaning.surrogate_ids(df, "sid", "S", "k").orderBy("k").collect()] == [(1, "S150"), (2, "S151"), (3, "S152"), (4, "S7"), (5, "S153")]
    blank = spark.createDataFrame([(k, None) for k in range(950)], "k int, sid string")
    ids = {r.sid for r in cleaning.surrogate_ids(blank, "sid", "S", "k", bands=7).collect()}
    assert ids == {f"S{101 + k}" for k in range(950)}


def test_changes_are_asked_in_order(spark):
    """A late change with equal attributes is outdated, one at the very start is not."""
    history = spark.createDataFrame([("u", "a", ts(5), None, True)], HISTORY)
    changes = spark.createDataFrame([("u", "a", ts(4)), ("u", "b", ts(4)), ("u", "a", ts(5)), ("u", "b", ts(5)), ("u", "a", ts(6)), ("u", "b", ts(6)), ("v", "a", ts(1))], "user string, plan string, at timestamp")
    out = {(r.user, r.plan, r["at"].day): r.decision for r in merge.classified(history, changes, "user", ["plan"], "at").collect()}
    assert out == {("u", "a", 4): "OUTDATED", ("u", "b", 4): "OUTDATED", ("u", "a", 5): "NO_CHANGE", ("u", "b", 5): "VALID", ("u", "a", 6): "NO_CHANGE", ("u", "b", 6): "VALID", ("v", "a", 1): "NEW"}


def test_type_1_takes_one_row_of_a_key(spark):
    target = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1))], "id int, v string, seen date")
    batch = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (2, "p", 4), (2, "q", 3)], "id int, v string, at int")
    now = F.lit("2024-02-02").cast("date")
    assert sorted((r.id, r.v) for r in merge.scd1(target, batch, "id", [], "seen", now, F.desc("at")).collect()) == [(1, "z"), (2, "p")]
    assert merge.scd1(target, batch, "id", [], "seen", now).count() == 2


def test_type_2_shuffles_once(spark):
    """All windows of the merge share one exchange by key."""
    history = spark.createDataFrame([("u", "a", ts(5), None, True)], HISTORY)
    changes = spark.createDataFrame([("u", "b", ts(6))], "user string, plan string, at timestamp")
    text = diagnostics.plan_text(merge.scd2(history, changes, "user", ["plan"], "at", "merge"), "simple")
    assert text.count("Window") and text.count("hashpartitioning(user#") - text.count("hashpartitioning(user#0, plan") <= 2


def test_salted_sum_keeps_keys_with_underscores_apart(spark):
    df = spark.range(10_000).selectExpr("CASE WHEN id % 10 = 0 THEN 'cust_hot' ELSE concat('cust_', id % 90, '_', id % 3) END AS k", "id", "1 AS v")
    plain = {r.k: r.n for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
    salted = {r.k: r.s for r in skew.salted_sum(df, ["k"], {"s": "v"}, 5).collect()}
    assert plain == salted


def test_fills(spark):
    rows = [("A", i, v) for i, v in enumerate([10.0, None, 30.0, 40.0, None, None, 70.0])]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    out = df.select("i", timeseries.forward_fill("v", ["g"], "i").alias("f"), timeseries.backward_fill("v", ["g"], "i").alias("b"), timeseries.neighbour_mean("v", ["g"], "i").alias("m"), timeseries.interpolated("v", ["g"], "i").alias("l")).orderBy("i").collect()
    assert [r.f for r in out] == [10, 10, 30, 40, 40, 40, 70]
    assert [r.b for r in out] == [10, 30, 30, 40, 70, 70, 70]
    assert [r.m for r in out] == [10, 20, 30, 40, None, None, 70]
    assert [r.l for r in out] == [10, 20, 30, 40, 50, 60, 70]


def test_densified_running_total(spark):
    days = [("S1", 1, 15), ("S1", 2, 22), ("S1", 4, 18), ("S1", 5, 25)]
    df = spark.createDataFrame([(s, dt.date(2024, 1, d), n) for s, d, n in days], "s string, day date, n int")
    assert [r.running for r in timeseries.densified_running(df, ["s"], "day", "n").orderBy("day").collect()] == [15, 37, 37, 55, 80]


def test_rows_and_days_roll_differently(spark):
    days = [(1, 1000), (2, 1200), (3, 1100), (22, 1400), (23, 150)]
    df = spark.createDataFrame([("p", dt.date(2024, 1, d), n) for d, n in days], "p string, day date, n int")
    out = df.select(W.rolling_rows("n", ["p"], 3, "day").alias("r"), W.rolling_days("n", ["p"], 3, "day").alias("d"), "day").orderBy("day").collect()
    assert [r.r for r in out] == [1000, 2200, 3300, 3700, 2650] and [r.d for r in out] == [1000, 2200, 3300, 1400, 1550]


HISTORY = "user string, plan string, effective_from timestamp, effective_to timestamp, is_current boolean"


def ts(day):
    return dt.datetime(2024, 1, day)


@pytest.mark.parametrize("late", ["skip", "merge"])
def test_type_2_history_can_be_run_again(spark, late):
    history = spark.createDataFrame([("u1", "basic", ts(1), None, True), ("u2", "pro", ts(5), None, True)], HISTORY)
    changes = spark.createDataFrame([("u1", "pro", ts(3)), ("u1", "max", ts(4)), ("u1", "max", ts(4)), ("u1", "max", ts(6)), ("u2", "basic", ts(2)), ("u3", "basic", ts(7)), (None, "x", ts(1))], "user string, plan string, at timestamp")
    once = merge.scd2(history, changes, "user", ["plan"], "at", late)
    again = merge.scd2(once, changes, "user", ["plan"], "at", late)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(once) == key(again)
    assert merge.current_per_key(once, "user").count() == 0
    assert once.count() == (5 if late == "skip" else 6)


def test_type_1_counts(spark):
    target = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1)), (2, "b", dt.date(2024, 1, 1)), (3, "c", dt.date(2024, 1, 1))], "id int, v string, seen date")
    batch = spark.createDataFrame([(1, "A"), (2, "B"), (4, "D"), (5, "E")], "id int, v string")
    out = merge.change_counts(merge.scd1(target, batch, "id", [], "seen", F.lit("2024-02-02").cast("date"))).first()
    assert tuple(out) == (2, 1, 2, 5)


def test_redelivered_row_with_a_null_key_is_not_appended_again(spark):
    target = spark.createDataFrame([("c", None, 1)], "c string, t string, n int")
    assert merge.append_new(target, target, ["c", "t"]).count() == 1


def test_dirty_sales(spark):
    rows = [("ann  lee", "elec x", "10.5", "2024-01-31", "east", "A@b.co"), ("bob", "home", "abc", "2024-01-31", "", None), ("cy", "home", "5", "31-01-2024", None, "bad"), ("di", "home", "5", "2024-01-32", "w", "x@y.zz"), (None, "home", "5", "01/31/2024", "w", None)]
    df = spark.createDataFrame(rows, "salesperson string, category string, amount string, sale_date string, region string, email string")
    out = cleaning.clean_sales(df, categories={"ELEC": "Electronics"}).orderBy("salesperson").collect()
    assert [(r.salesperson, r.category, r.region, r.email) for r in out] == [("Ann Lee", "Electronics", "East", "a@b.co"), ("Cy", "Home", "Unknown", None)]


def test_schema_conforms(spark):
    target = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, pay double")
    other = spark.createDataFrame([("x", "7", 1)], "NAME string, Id string, extra int")
    assert [tuple(r) for r in quality.conformed(other, target.schema).collect()] == [(7, "x", None)]


def test_hints_choose_the_join(spark):
    a, b = spark.range(100), spark.range(100)
    for strategy, kind in (("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin")):
        assert kind in diagnostics.plan_text(joins.join(a, b, "id", strategy=strategy))
