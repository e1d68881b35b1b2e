"""Named queries over the tables of a folder, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import columns as C
from ..functions import predicates as P
from ..operators import aggregates as A
from ..operators import cleaning, joins, merge, nested, quality, setops, skew, timeseries
from ..operators import windows as W
from ..session import table
from ..streaming.changes import windowed_counts
from . import diagnostics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def money(column: Column) -> Column:
    return F.round(column, 2)


def line_revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


REV = "l_extendedprice * (1 - l_discount)"
#: Nulls made where the tables have none.
NULLED = {"c_name": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END", "c_acctbal": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END", "c_mktsegment": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END", "c_nationkey": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END"}
NULLED_SQL = "(SELECT c_custkey, " + ", ".join(f"{e} AS {c}" for c, e in NULLED.items()) + " FROM customer)"


def nulled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").selectExpr("c_custkey", *(f"{e} AS {c}" for c, e in NULLED.items()))


def daily(s: SparkSession, d: str) -> DataFrame:
    """Priority, day, whole total of orders by day."""
    o = table(s, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return o.groupBy("o_orderpriority", "day").agg(F.sum("cents").alias("cents"))


DAILY = "(SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL)"
USER_DAY = "(SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS hits, round(sum(value), 2) AS total FROM events GROUP BY ALL)"


def user_day(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("value"), 2).alias("total"))


SERIES = f"(SELECT user_id, day, CASE WHEN (user_id + dayofmonth(day)) % 3 = 0 THEN NULL ELSE hits END AS hits FROM {USER_DAY})"


def series(s: SparkSession, d: str) -> DataFrame:
    return user_day(s, d).select("user_id", "day", F.when((F.col("user_id") + F.dayofmonth("day")) % 3 != 0, F.col("hits")).alias("hits"))


# --- flagship and star joins -------------------------------------------------


def star(s: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    c, o = table(s, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment"), table(s, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), "o_orderdate")
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), line_revenue().alias("revenue"))
    joined = joins.star_join(lines, [(o, "orderkey"), (c, "custkey")], strategy)
    out = joined.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(money(F.sum("revenue")).alias("revenue"), n("lines"))
    return out.withColumn("tier", C.tier(F.col("revenue"), (1_000_000, "high"), (100_000, "medium"), otherwise="low"))


STAR = f"""
SELECT *, CASE WHEN revenue >= 1000000 THEN 'high' WHEN revenue >= 100000 THEN 'medium' ELSE 'low' END AS tier FROM (
SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, round(sum({REV}), 2) AS revenue, CAST(count(*) AS BIGINT) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(STAR)
def flagship_star_revenue(s, d):
    return star(s, d).orderBy("c_mktsegment", "month")


@query(STAR)
def star_sort_merge(s, d):
    return star(s, d, "merge")


@query(STAR)
def star_shuffle_hash(s, d):
    return star(s, d, "shuffle_hash")


NATION_REVENUE = "SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"


@query(NATION_REVENUE)
def star_broadcast(s, d):
    c, na, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    # nation and region are reference tables of fixed size
    out = joins.join(c, na, F.col("c_nationkey") == F.col("n_nationkey"), strategy="broadcast")
    return joins.join(out, r, F.col("n_regionkey") == F.col("r_regionkey"), strategy="broadcast").groupBy("n_name", "r_name").agg(n("customers"))


@query(NATION_REVENUE)
def star_sql_hint(s, d):
    return s.sql(
        "SELECT /*+ BROADCAST(n), BROADCAST(r) */ n_name, r_name, count(*) AS customers FROM {c} c JOIN {n} n ON c_nationkey = n_nationkey JOIN {r} r ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
        c=table(s, d, "customer"), n=table(s, d, "nation"), r=table(s, d, "region"),
    )


# --- projection and filters --------------------------------------------------


@query("SELECT p_partkey, p_retailprice * 0.1 AS tenth, upper(p_name) AS name_upper, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class, p_brand || '-' || p_type AS label, CAST(p_size AS DOUBLE) AS size_d FROM part")
def select_expr(s, d):
    return table(s, d, "part").selectExpr("p_partkey", "p_retailprice * 0.1 AS tenth", "upper(p_name) AS name_upper", "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class", "concat(p_brand, '-', p_type) AS label", "CAST(p_size AS DOUBLE) AS size_d")


@query("SELECT c_custkey, c_nationkey FROM customer")
def regex_select(s, d):
    return C.select_matching(table(s, d, "customer"), "c_.*key")


@query("SELECT c_name, c_mktsegment FROM customer")
def type_select(s, d):
    c = table(s, d, "customer")
    return c.select(*C.columns_of_type(c, StringType))


@query("SELECT c_custkey, c_name FROM customer")
def ordinal_except_select(s, d):
    return C.select_at(C.select_except(table(s, d, "customer"), "c_acctbal"), 0, 1)


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_size > 10")
def struct_pack_unpack(s, d):
    p = C.packed(table(s, d, "part").filter("p_size > 10"), "info", ["p_name", "p_brand", "p_type"])
    return C.unpacked(p, "info").select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'gold' WHEN c_acctbal >= 2500 THEN 'silver' WHEN c_acctbal BETWEEN 0 AND 2500 THEN 'bronze' ELSE 'debt' END AS grade FROM customer")
def case_tier(s, d):
    b = F.col("c_acctbal")
    return table(s, d, "customer").select("c_custkey", C.case((b >= 7500, "gold"), (b >= 2500, "silver"), (b.between(0, 2500), "bronze"), otherwise="debt").alias("grade"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS is_f, CAST(o_orderstatus = 'O' AS INT) AS is_o, CAST(o_orderstatus = 'P' AS INT) AS is_p, o_totalprice AS total FROM orders")
def flags_and_rename(s, d):
    o = C.with_all(table(s, d, "orders"), C.flags(F.col("o_orderstatus"), ["F", "O", "P"]))
    return C.renamed(o, {"o_totalprice": "total"}).select("o_orderkey", "is_f", "is_o", "is_p", "total")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderpriority LIKE '%URGENT%' OR regexp_matches(o_orderpriority, '^[23]')) AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND NOT (o_orderkey % 2 = 0) AND o_orderdate >= TIMESTAMP '1996-01-01'")
def filter_like_rlike_in_between(s, d):
    p = F.col("o_orderpriority")
    o = table(s, d, "orders").filter((p.like("%URGENT%") | p.rlike("^[23]")) & F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000))
    return o.where(~(F.col("o_orderkey") % 2 == 0)).filter("o_orderdate >= timestamp_ntz'1996-01-01'").select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_type, 'A') AND p_size <> 10")
def filter_contains(s, d):
    return table(s, d, "part").filter(F.col("p_type").contains("A") & (F.col("p_size") != 10)).select("p_partkey", "p_name")


@query(f"SELECT c_custkey FROM {NULLED_SQL} WHERE c_name IS NULL OR c_acctbal IS NULL OR c_mktsegment IS NULL")
def any_null(s, d):
    return nulled(s, d).filter(P.any_null(["c_name", "c_acctbal", "c_mktsegment"])).select("c_custkey")


@query(f"SELECT c_custkey FROM {NULLED_SQL} WHERE c_name IS NULL AND c_acctbal IS NULL")
def all_null_subset(s, d):
    return nulled(s, d).filter(P.all_null(["c_name", "c_acctbal"])).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-01'")
def on_day(s, d):
    return table(s, d, "orders").filter(P.on_day(F.col("o_orderdate"), F.lit("1997-03-01"))).select("o_orderkey")


# --- joins -------------------------------------------------------------------


SOME_CUSTOMER = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_custkey END"


def customer_orders(s, d):
    """All customers, and all orders, every fifth of which names no customer and every seventh an unknown one."""
    return table(s, d, "customer").select("c_custkey", "c_name"), table(s, d, "orders").selectExpr("o_orderkey", f"{SOME_CUSTOMER} AS o_custkey", "o_totalprice")


def join_sql(how: str) -> str:
    return f"SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice FROM customer {how} JOIN (SELECT o_orderkey, {SOME_CUSTOMER} AS o_custkey, o_totalprice FROM orders) ON c_custkey = o_custkey"


def join_query(how: str) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        a, b = customer_orders(s, d)
        return joins.join(a, b, F.col("c_custkey") == F.col("o_custkey"), how)

    return run


for _how in ("inner", "left", "right", "full"):
    QUERIES[f"join_{_how}"], SQL[f"join_{_how}"] = join_query(_how), join_sql(_how.upper())


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def join_semi(s, d):
    return joins.join(table(s, d, "customer"), table(s, d, "orders").filter("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(s, d):
    return joins.join(table(s, d, "orders"), table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(s, d):
    r = table(s, d, "region")
    return r.select(F.col("r_name").alias("a")).crossJoin(r.select(F.col("r_name").alias("b")))


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS parent_name FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey")
def join_self(s, d):
    return joins.self_join(table(s, d, "nation"), "n_nationkey", "n_regionkey", {"n_name": "parent_name"}).select("n_nationkey", "n_name", "parent_name")


@query("SELECT n_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(s, d):
    return joins.natural_join(table(s, d, "nation"), table(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")).select("n_regionkey", "n_name", "r_name")


@query("SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_quantity > 45) ON l_partkey = pk AND l_suppkey = sk GROUP BY ALL")
def join_multi_key(s, d):
    lines = table(s, d, "lineitem")
    return joins.join(lines, lines.filter("l_quantity > 45").select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(n())


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment LIKE 'A%'")
def join_residual(s, d):
    return joins.join(table(s, d, "orders"), table(s, d, "customer"), (F.col("o_custkey") == F.col("c_custkey")) & F.col("c_mktsegment").like("A%")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000")
def join_co_partitioned(s, d):
    o, l = table(s, d, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return joins.co_partitioned_join(o, l, ["o_orderkey"])


#: A band of sizes for each size there is, some without a lower bound.
BANDS = "(SELECT DISTINCT p_size AS band, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size END AS lo, p_size + 3 AS hi FROM part)"


@query(f"SELECT p_partkey, band, lo, hi FROM part JOIN {BANDS} ON p_size BETWEEN lo AND hi")
def range_join(s, d):
    bands = table(s, d, "part").selectExpr("p_size AS band", "CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size END AS lo", "p_size + 3 AS hi").distinct()
    return joins.range_join(table(s, d, "part").select("p_partkey", "p_size"), bands, "p_size", "lo", "hi", 4).select("p_partkey", "band", "lo", "hi")


TWO_SIDES = f"(SELECT c_custkey, c_nationkey AS k FROM {NULLED_SQL}) a"
OTHER_SIDE = "(SELECT n_name, CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) b"


def two_sides(s, d):
    a = nulled(s, d).selectExpr("c_custkey", "c_nationkey AS k")
    return a, table(s, d, "nation").selectExpr("n_name", "CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE n_nationkey END AS k")


@query(f"SELECT c_custkey, a.k AS k, n_name FROM {TWO_SIDES} JOIN {OTHER_SIDE} ON a.k IS NOT DISTINCT FROM b.k")
def null_safe_join(s, d):
    return joins.null_safe_join(*two_sides(s, d), ["k"]).select("c_custkey", "k", "n_name")


@query(f"SELECT c_custkey, coalesce(a.k, -999) AS k, n_name FROM {TWO_SIDES} JOIN {OTHER_SIDE} ON coalesce(a.k, -999) = coalesce(b.k, -999)")
def sentinel_join(s, d):
    return joins.sentinel_join(*two_sides(s, d), ["k"], -999).select("c_custkey", "k", "n_name")


@query(f"SELECT c_custkey, k FROM {TWO_SIDES} WHERE k IS NOT NULL")
def prepare_keys(s, d):
    return joins.prepare_keys(two_sides(s, d)[0], ["k"], "filter")


@query("SELECT n_nationkey AS left_key, n_name AS left_name, r_name AS right_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def pair_join(s, d):
    both = joins.pair_join(table(s, d, "nation"), table(s, d, "region"), F.expr("l.n_regionkey = r.r_regionkey"))
    return both.select(F.col("left.n_nationkey").alias("left_key"), F.col("left.n_name").alias("left_name"), F.col("right.r_name").alias("right_name"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(max(m) AS BIGINT) AS most FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderkey) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey)")
def join_diagnostics(s, d):
    out = diagnostics.join_size(table(s, d, "orders").select(F.col("o_orderkey").alias("k")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])
    return out.select(F.col("rows").cast("long").alias("rows"), F.col("most_of_a_key").cast("long").alias("most"))


@query("SELECT p_brand, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def salted_join(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity", "l_orderkey", "l_linenumber")
    return skew.salted_join(lines, table(s, d, "part").select(F.col("p_partkey").alias("k"), "p_brand"), "k", least=25, salts=5).groupBy("p_brand").agg(money(F.sum("l_quantity")).alias("qty"))


# --- aggregates --------------------------------------------------------------


@query(f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({REV}), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty, max(l_extendedprice) AS max_price, min(l_discount) AS min_discount, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def agg_multi(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum(line_revenue())).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.max("l_extendedprice").alias("max_price"), F.min("l_discount").alias("min_discount"), n())


@query("SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS statuses FROM orders GROUP BY ALL")
def agg_distinct(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"))


@query("SELECT round(avg(c_acctbal), 4) AS mean, median(c_acctbal) AS median, CAST(count(*) AS BIGINT) AS n FROM customer")
def agg_global_median(s, d):
    c = table(s, d, "customer")
    rest = c.agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), n()).withColumn("one", F.lit(1))
    # both sides are one row
    return rest.join(F.broadcast(W.quantile(c, "c_acctbal").select(F.col("q").alias("median"), F.lit(1).alias("one"))), "one").select("mean", "median", "n")


@query(f"SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(count(c_acctbal) AS BIGINT) AS known, CAST(count(*) - count(c_acctbal) AS BIGINT) AS nulls, round(sum(coalesce(c_acctbal, 0)), 2) AS total FROM {NULLED_SQL} GROUP BY ALL")
def agg_null_aware(s, d):
    return nulled(s, d).groupBy("c_mktsegment").agg(n(), F.count("c_acctbal").alias("known"), F.count_if(F.col("c_acctbal").isNull()).alias("nulls"), money(F.sum(F.coalesce("c_acctbal", F.lit(0.0)))).alias("total"))


@query("SELECT o_custkey, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS finished, round(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS open_total, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 2) AS pct FROM orders GROUP BY ALL")
def cond_agg(s, d):
    f = F.col("o_orderstatus")
    out = table(s, d, "orders").groupBy("o_custkey").agg(A.count_where(f == "F").alias("finished"), money(A.sum_where(f == "O", F.col("o_totalprice"))).alias("open_total"), n("all"))
    return out.select("o_custkey", "finished", "open_total", C.ratio(F.col("finished"), F.col("all"), 100, 2).alias("pct"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 100000 THEN o_totalprice END), 2) AS high, round(avg(CASE WHEN o_totalprice <= 100000 THEN o_totalprice END), 2) AS low FROM orders GROUP BY ALL")
def cond_avg(s, d):
    p = F.col("o_totalprice")
    return table(s, d, "orders").groupBy("o_orderpriority").agg(money(A.mean_where(p > 100000, p)).alias("high"), money(A.mean_where(p <= 100000, p)).alias("low"))


@query("SELECT o_custkey, CAST(sum(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 WHEN 'P' THEN -1 ELSE 0 END) AS BIGINT) AS score FROM orders GROUP BY ALL")
def weighted_score(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(A.weighted_score(F.col("o_orderstatus"), {"F": 2, "O": 1, "P": -1}).alias("score"))


@query("SELECT c_mktsegment, CAST(sum(cents) AS BIGINT) AS cents, round(100.0 * sum(cents) / sum(sum(cents)) OVER (), 2) AS cents_pct FROM (SELECT c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer) GROUP BY ALL")
def share_of_total(s, d):
    return A.share_of_total(table(s, d, "customer"), ["c_mktsegment"], F.round(F.col("c_acctbal") * 100).cast("long"), "cents")


PIVOT = "(SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS \"F\", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS \"O\", round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS \"P\" FROM orders GROUP BY ALL)"


@query(f"SELECT * FROM {PIVOT}")
def pivot_status(s, d):
    out = A.pivot_sum(table(s, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.col("o_totalprice"))
    return out.select("o_orderpriority", *(money(F.col(c)).alias(c) for c in "FOP"))


@query(f'SELECT o_orderpriority, round(100 * "F" / ("F" + "O" + "P"), 2) AS "F_pct", round(100 * "O" / ("F" + "O" + "P"), 2) AS "O_pct", round(100 * "P" / ("F" + "O" + "P"), 2) AS "P_pct" FROM {PIVOT}')
def pivot_share(s, d):
    return A.pivot_share(pivot_status(s, d), ["o_orderpriority"], ["F", "O", "P"])


@query("SELECT c_mktsegment, round(avg(datediff('day', DATE '1995-01-01', first_day)), 4) AS mean_days, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY ALL) JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def first_order_lag_avg(s, d):
    first = table(s, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first_day"))
    gap = C.days(F.lit("1995-01-01").cast("date"), F.col("first_day"))
    return first.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.avg(gap), 4).alias("mean_days"), n())


@query("SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(weekofyear(o_orderdate) AS INT) AS w, strftime(o_orderdate, '%Y-%m') AS ym, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def calendar_grouping(s, d):
    t = "o_orderdate"
    return table(s, d, "orders").groupBy(F.year(t).alias("y"), F.quarter(t).alias("q"), F.month(t).alias("m"), F.weekofyear(t).alias("w"), F.date_format(t, "yyyy-MM").alias("ym")).agg(n())


@query(
    """SELECT p_brand, round(revenue, 2) AS revenue, round(profit, 2) AS profit, lines, orders, round(100 * profit / revenue, 2) AS margin_pct, round(revenue / orders, 2) AS per_order, round(revenue / lines, 2) AS per_line
    FROM (SELECT p_brand, sum((l_extendedprice / l_quantity - l_discount) * l_quantity) AS revenue, sum((l_extendedprice / l_quantity - l_discount) * l_quantity - p_retailprice * 0.6 * l_quantity) AS profit,
    CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
)
def profit_metrics(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = A.profit_metrics(j, ["p_brand"], F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity"), F.col("p_retailprice") * 0.6, "l_orderkey")
    return out.withColumns({"revenue": money(F.col("revenue")), "profit": money(F.col("profit"))})


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedup_subset(s, d):
    return A.deduplicated(table(s, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


WORDS = "(SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents)"


@query(f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM {WORDS} WHERE word <> '' GROUP BY ALL")
def word_count(s, d):
    return A.word_count(table(s, d, "documents"))


@query(f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM {WORDS} WHERE word <> '' GROUP BY ALL ORDER BY n DESC, word LIMIT 20")
def top_words(s, d):
    return setops.top_k(A.word_count(table(s, d, "documents")), 20, F.desc("n"), F.col("word"))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders WHERE o_totalprice > 100000 GROUP BY ALL")
def collect_sorted(s, d):
    return table(s, d, "orders").filter("o_totalprice > 100000").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))


@query("SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def salted_agg(s, d):
    lines = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    return skew.salted_sum(lines, ["l_partkey"], {"cents": "c"})


@query("SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 600")
def having_frequent(s, d):
    return skew.frequent_keys(table(s, d, "lineitem"), "l_suppkey", 600)


# --- windows -----------------------------------------------------------------


@query("SELECT c_nationkey, c_custkey, c_acctbal, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) WHERE position <= 3")
def top_n(s, d):
    return W.top_n(table(s, d, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.col("c_custkey"), n=3).select("c_nationkey", "c_custkey", "c_acctbal", "position")


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INT) AS row_number, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS rank, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS dense_rank FROM part")
def rank_family(s, d):
    return W.ranks(table(s, d, "part"), ["p_brand"], F.col("p_size"), tiebreak=[F.col("p_partkey")]).select("p_partkey", "row_number", "rank", "dense_rank")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_size) AS BIGINT) AS position FROM part")
def global_rank(s, d):
    return W.global_rank(table(s, d, "part").select("p_partkey", "p_size"), F.col("p_size")).select("p_partkey", F.col("position").cast("long").alias("position"))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT p_size) AS BIGINT) AS values, CAST(count_if(k <> r) AS BIGINT) AS tied, round(100.0 * count_if(k <> r) / count(*), 2) AS tied_pct FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) GROUP BY ALL")
def tie_stats(s, d):
    return W.tie_stats(table(s, d, "part"), ["p_brand"], "p_size", "p_partkey")


@query("SELECT p_partkey, CAST(a AS INT) AS rank_a, CAST(b AS INT) AS rank_b FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS a, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS b FROM part) WHERE a = 1 AND b > 1")
def rank_disagreement(s, d):
    return W.rank_disagreement(table(s, d, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_partkey", "rank_a", "rank_b")


@query("SELECT event_id, v AS value, lag(v) OVER w AS previous, lead(v) OVER w AS following, first_value(v) OVER w AS first, CASE WHEN lag(v) OVER w IS NULL THEN 'first' WHEN v > lag(v) OVER w THEN 'up' WHEN v < lag(v) OVER w THEN 'down' ELSE 'same' END AS trend, CAST(datediff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS INT) AS gap_days, v - first_value(v) OVER w AS from_first FROM (SELECT *, value AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def timeline(s, d):
    return W.timeline(table(s, d, "events"), ["user_id"], "value", "ts").select("event_id", "value", "previous", "following", "first", "trend", "gap_days", "from_first")


@query(
    """SELECT event_id, CASE WHEN p IS NULL THEN 'first' WHEN value > p THEN 'increased' WHEN value < p THEN 'decreased' ELSE 'same' END AS variance,
    CASE WHEN pd IS NULL THEN 'first' WHEN gap <= 1 THEN 'frequent' WHEN gap <= 3 THEN 'regular' ELSE 'infrequent' END AS frequency,
    CASE WHEN f IS NULL THEN 'last' WHEN f > value THEN 'will rise' WHEN f < value THEN 'will fall' ELSE 'will stay' END AS outlook,
    CASE WHEN fd IS NULL THEN 'gone' WHEN ahead <= 1 THEN 'soon' WHEN ahead <= 3 THEN 'later' ELSE 'rare' END AS comes_back,
    CASE WHEN value > v1 THEN 'more than first' WHEN value < v1 THEN 'less than first' ELSE 'as first' END AS evolution
    FROM (SELECT *, datediff('day', pd, d) AS gap, datediff('day', d, fd) AS ahead FROM (SELECT event_id, value, CAST(ts AS DATE) AS d, lag(value) OVER w AS p, lead(value) OVER w AS f, CAST(lag(ts) OVER w AS DATE) AS pd, CAST(lead(ts) OVER w AS DATE) AS fd, first_value(value) OVER w AS v1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)))"""
)
def lag_lead_labels(s, d):
    w, value, when = Window.partitionBy("user_id").orderBy("ts"), F.col("value"), F.col("ts")
    near = table(s, d, "events").withColumns({"before": F.lag("value").over(w), "after": F.lead("value").over(w), "first": F.first_value("value").over(w), "gap": F.datediff(when, F.lag("ts").over(w)), "ahead": F.datediff(F.lead("ts").over(w), when)})
    return near.select(
        "event_id",
        W.compared(value, F.col("before"), "increased", "decreased", "same", "first").alias("variance"),
        W.pace(F.col("gap"), (1, "frequent"), (3, "regular"), otherwise="infrequent", none="first").alias("frequency"),
        W.compared(F.col("after"), F.when(F.col("after").isNotNull(), value), "will rise", "will fall", "will stay", "last").alias("outlook"),
        W.pace(F.col("ahead"), (1, "soon"), (3, "later"), otherwise="rare", none="gone").alias("comes_back"),
        W.compared(value, F.col("first"), "more than first", "less than first", "as first", "none").alias("evolution"),
    )


@query(f"SELECT o_orderpriority, day, CAST(sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM {DAILY}")
def running_total(s, d):
    return daily(s, d).select("o_orderpriority", "day", W.running_sum("cents", ["o_orderpriority"], "day").alias("running"))


@query(f"SELECT o_orderpriority, day, CAST(sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY day ROWS 2 PRECEDING) AS BIGINT) AS rolling FROM {DAILY}")
def rolling_3rows(s, d):
    return daily(s, d).select("o_orderpriority", "day", W.rolling_rows("cents", ["o_orderpriority"], 3, "day").alias("rolling"))


@query(f"SELECT o_orderpriority, day, CAST(sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM {DAILY}")
def rolling_3days(s, d):
    return daily(s, d).select("o_orderpriority", "day", W.rolling_days("cents", ["o_orderpriority"], 3, "day").alias("rolling"))


@query(f"SELECT o_orderpriority, iso, CAST(cents AS BIGINT) AS cents, round(100.0 * (cents - lag(cents) OVER w) / lag(cents) OVER w, 2) AS growth FROM (SELECT o_orderpriority, CAST(isoyear(day) * 100 + weekofyear(day) AS INT) AS iso, sum(cents) AS cents FROM {DAILY} GROUP BY ALL) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY iso)")
def wow_growth(s, d):
    iso = (F.extract(F.lit("YEAROFWEEK"), F.col("day")) * 100 + F.weekofyear("day")).cast("int")
    weeks = daily(s, d).groupBy("o_orderpriority", iso.alias("iso")).agg(F.sum("cents").alias("cents"))
    return weeks.withColumn("growth", W.growth("cents", ["o_orderpriority"], "iso"))


@query(f"SELECT month, CAST(cents AS BIGINT) AS cents, round(100.0 * (cents - lag(cents) OVER w) / lag(cents) OVER w, 2) AS growth, CAST(sum(cents) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT strftime(day, '%Y-%m') AS month, sum(cents) AS cents FROM {DAILY} GROUP BY ALL) WINDOW w AS (ORDER BY month)")
def mom_growth(s, d):
    months = daily(s, d).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("cents").alias("cents"))
    return months.withColumns({"growth": W.growth("cents", [], "month"), "running": W.running_sum("cents", [], "month")})


SPANS = f"(SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM {USER_DAY} GROUP BY user_id)"


@query(f"SELECT user_id, day, coalesce(hits, 0) AS hits, CAST(sum(coalesce(hits, 0)) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM {SPANS} LEFT JOIN {USER_DAY} USING (user_id, day)")
def densify_running(s, d):
    return timeseries.densified_running(user_day(s, d).select("user_id", "day", "hits"), ["user_id"], "day", "hits")


@query(f"SELECT user_id, day, last_value(hits IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS hits FROM {SERIES}")
def ffill(s, d):
    return series(s, d).select("user_id", "day", timeseries.forward_fill("hits", ["user_id"], "day").alias("hits"))


@query(f"SELECT user_id, day, first_value(hits IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hits FROM {SERIES}")
def bfill(s, d):
    return series(s, d).select("user_id", "day", timeseries.backward_fill("hits", ["user_id"], "day").alias("hits"))


@query(f"SELECT user_id, day, CAST(coalesce(hits, (lag(hits) OVER w + lead(hits) OVER w) / 2.0) AS DOUBLE) AS hits FROM {SERIES} WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def interp(s, d):
    return series(s, d).select("user_id", "day", timeseries.neighbour_mean("hits", ["user_id"], "day").cast("double").alias("hits"))


@query(f"SELECT user_id, day, CAST(datediff('day', lag(day) OVER w, day) AS INT) AS gap_days, coalesce(datediff('day', lag(day) OVER w, day) > 1, false) AS is_gap FROM {USER_DAY} WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def gap_flags(s, d):
    return timeseries.gaps(user_day(s, d).select("user_id", "day"), ["user_id"], "day")


# --- sets --------------------------------------------------------------------


def nation_keys(s, d):
    return table(s, d, "customer").filter("c_nationkey < 15").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").filter("s_nationkey > 8").select(F.col("s_nationkey").alias("k"))


SET_A, SET_B = "(SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15)", "(SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 8)"


@query(f"SELECT k FROM {SET_A} UNION ALL SELECT k FROM {SET_B}")
def union_by_name(s, d):
    return setops.union(*nation_keys(s, d))


@query(f"SELECT k FROM {SET_A} INTERSECT SELECT k FROM {SET_B}")
def intersect(s, d):
    return setops.intersection(*nation_keys(s, d))


@query(f"SELECT k FROM {SET_A} EXCEPT SELECT k FROM {SET_B}")
def except_distinct(s, d):
    return setops.difference(*nation_keys(s, d))


@query(f"SELECT k FROM {SET_A} WHERE k NOT IN (SELECT k FROM {SET_B}) UNION ALL SELECT k FROM {SET_B} WHERE k NOT IN (SELECT k FROM {SET_A})")
def sym_diff(s, d):
    return setops.symmetric_difference(*nation_keys(s, d), ["k"])


@query("SELECT DISTINCT v FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS v FROM events) WHERE v IS NOT NULL AND v <> ''")
def clean_set(s, d):
    return setops.cleaned(table(s, d, "events").selectExpr("CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS v"), "v")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(s, d):
    return setops.top_k(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


# --- nested data and functions -----------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT conv_id, turn, role, word FROM (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS word FROM conversations)")
def nested_explode(s, d):
    turns = table(s, d, "conversations").select("conv_id", F.array(F.struct("turn", "role", F.split("text", " ").alias("words"))).alias("turns"))
    return nested.exploded(turns, {"turns": "t", "t.words": "word"}).select("conv_id", "t.turn", "t.role", "word")


@query("SELECT conv_id, role, CAST(count(DISTINCT turn) AS BIGINT) AS turns, CAST(count(word) AS BIGINT) AS words FROM (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY ALL")
def lateral_view(s, d):
    nested_turns = table(s, d, "conversations").select("conv_id", "turn", F.array(F.struct("role", F.split("text", " ").alias("words"))).alias("said"))
    return s.sql(
        "SELECT conv_id, one.role AS role, count(DISTINCT turn) AS turns, count(word) AS words FROM {t} LATERAL VIEW OUTER EXPLODE(said) AS one LATERAL VIEW OUTER EXPLODE(one.words) AS word GROUP BY conv_id, one.role",
        t=nested_turns,
    )


@query("SELECT n_nationkey AS nation_key, n_name AS nation_name, r_name AS nation_region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def flatten_paths(s, d):
    n_, r = table(s, d, "nation"), table(s, d, "region")
    deep = n_.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"))
    return nested.flattened(deep)


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS there, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 6 = 1 THEN 'none' ELSE c_mktsegment END AS segment FROM customer")
def struct_defaults(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.struct(F.when(F.col("c_custkey") % 6 != 1, F.col("c_mktsegment")).alias("segment"))).alias("info"))
    return c.select("c_custkey", F.col("info").isNotNull().alias("there"), nested.field_or("info", "segment", "none").alias("segment"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE c_mktsegment END AS segment, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS INT) AS known FROM customer")
def nested_defaults(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"))).alias("m"), F.array(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))).alias("a"))
    return c.select("c_custkey", nested.key_or(F.col("m"), "segment", "none").alias("segment"), nested.present(F.col("a")).alias("known"))


@query("SELECT c_custkey, lower(c_mktsegment) AS low, initcap AS title, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded, CAST(length(c_name) AS INT) AS len, string_split(c_name, '#')[-1] AS tail, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM (SELECT *, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS initcap FROM customer)")
def string_functions(s, d):
    return table(s, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("low"), F.initcap("c_mktsegment").alias("title"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("padded"), F.length("c_name").alias("len"), F.element_at(F.split("c_name", "#"), -1).alias("tail"), F.regexp_replace("c_name", "[^0-9]", "").alias("digits"))


MIXED_DATES = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'not a date' END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def mixed_dates(s, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "MM/dd/yyyy")).when(k == 2, F.date_format(t, "dd-MM-yyyy")).otherwise("not a date")
    return table(s, d, "orders").select("o_orderkey", C.date_of(text, "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy").alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS INT) END AS k, coalesce(CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END, 'none') AS text FROM customer")
def safe_casts(s, d):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("abc")
    return table(s, d, "customer").select("c_custkey", C.as_type(raw, "int").alias("k"), C.or_text(C.as_type(raw, "int"), "none").alias("text"))


# --- data quality ------------------------------------------------------------


@query(f"SELECT * FROM (SELECT 'c_custkey' AS \"column\", CAST(count(*) - count(c_custkey) AS BIGINT) AS nulls, round(100.0 * (count(*) - count(c_custkey)) / count(*), 2) AS null_pct FROM {NULLED_SQL}" + "".join(f" UNION ALL SELECT '{c}', CAST(count(*) - count({c}) AS BIGINT), round(100.0 * (count(*) - count({c})) / count(*), 2) FROM {NULLED_SQL}" for c in NULLED) + ")")
def null_profile(s, d):
    return quality.null_profile(nulled(s, d))


@query(f"SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM {NULLED_SQL}")
def drop_sparse(s, d):
    return quality.without_sparse_columns(nulled(s, d), 40)


@query(f"SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM {NULLED_SQL} WHERE (c_name IS NOT NULL)::INT + (c_acctbal IS NOT NULL)::INT + (c_mktsegment IS NOT NULL)::INT + (c_nationkey IS NOT NULL)::INT >= 3")
def dropna_thresh(s, d):
    return quality.dropped_nulls(nulled(s, d), least=4).select("c_custkey", *NULLED)


@query(f"SELECT c_custkey FROM {NULLED_SQL} WHERE (c_name IS NULL)::INT + (c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT <= 1")
def few_nulls(s, d):
    return quality.rows_with_few_nulls(nulled(s, d), 1, ["c_name", "c_acctbal", "c_mktsegment"]).select("c_custkey")


@query(f"SELECT c_custkey, coalesce(c_name, 'unknown') AS c_name, coalesce(c_acctbal, 0.0) AS c_acctbal, coalesce(c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'even' ELSE 'other' END) AS c_mktsegment FROM {NULLED_SQL}")
def fill_map(s, d):
    df = quality.filled(nulled(s, d), {"c_name": "unknown", "c_acctbal": 0.0})
    k = F.col("c_custkey") % 4
    return quality.filled_where(df, "c_mktsegment", (k == 0, "even"), (k != 0, "other")).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query(f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {NULLED_SQL})), 4) AS c_acctbal, CAST(coalesce(c_nationkey, (SELECT median(c_nationkey) FROM {NULLED_SQL})) AS DOUBLE) AS c_nationkey FROM {NULLED_SQL}")
def impute_mean(s, d):
    out = quality.imputed(nulled(s, d), {"c_acctbal": "mean", "c_nationkey": "median"})
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_nationkey")


@query(f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count_if(c_name IS NOT NULL AND c_acctbal IS NOT NULL) AS BIGINT) AS complete, round(100.0 * count_if(c_name IS NULL OR c_acctbal IS NULL) / count(*), 2) AS lost_pct FROM {NULLED_SQL}")
def null_impact(s, d):
    return quality.null_impact(nulled(s, d), ["c_name", "c_acctbal"])


@query(f"SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS c_acctbal, coalesce(c_mktsegment, 'NONE') AS c_mktsegment, NOT coalesce(c_acctbal BETWEEN 0 AND 5000, false) OR c_mktsegment IS NULL AS has_invalid FROM {NULLED_SQL}")
def range_rules(s, d):
    out = quality.ruled(nulled(s, d), {"c_acctbal": (F.col("c_acctbal").between(0, 5000), None), "c_mktsegment": (F.col("c_mktsegment").isNotNull(), "NONE")})
    return out.select("c_custkey", "c_acctbal", "c_mktsegment", "has_invalid")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS INT) AS age FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, CAST(NULL AS INT) FROM supplier")
def conform_union(s, d):
    target = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("balance", DoubleType()), StructField("age", IntegerType())])
    a = quality.conformed(table(s, d, "customer"), target, {"c_custkey": "ID", "c_name": "name", "c_acctbal": "balance"})
    b = table(s, d, "supplier").select(F.col("s_acctbal").cast("string").alias("Balance"), F.col("s_name").alias("NAME"), F.col("s_suppkey").alias("id"), "s_nationkey")
    return quality.conformed_union(a, b)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'INVALID' ELSE 'VALID' END AS status, 'customer' AS first_name, lpad(CAST(c_custkey AS VARCHAR), 10, '5') AS phone FROM customer")
def contact_validate(s, d):
    c = table(s, d, "customer").select(
        "c_custkey",
        F.concat(F.lit("  customer_@"), F.col("c_custkey").cast("string")).alias("full_name"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" C"), F.col("c_custkey").cast("string"), F.lit("@Mail.example "))).alias("email"),
        F.concat(F.lit("+"), F.lpad(F.col("c_custkey").cast("string"), 10, "5"), F.lit(" ")).alias("phone"),
    )
    return cleaning.contacts(c).select("c_custkey", "status", "first_name", "phone")


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'INVALID' ELSE 'VALID' END AS status, CAST(count(*) AS BIGINT) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM customer GROUP BY ALL")
def status_summary(s, d):
    return quality.status_summary(contact_validate(s, d), "status")


@query("SELECT CAST(count_if(c_custkey % 4 = 0 OR c_custkey % 6 = 0) AS BIGINT) AS v, CAST(count(*) AS BIGINT) AS rows FROM customer")
def blank_counts(s, d):
    v = F.when(F.col("c_custkey") % 4 == 0, None).when(F.col("c_custkey") % 6 == 0, "  ").otherwise(F.col("c_name"))
    return quality.blank_counts(table(s, d, "customer").select(v.alias("v")), ["v"])


# --- incremental loads -------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def append_new(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    batch = o.filter("o_orderkey % 3 = 0").unionByName(o.filter("o_orderkey % 6 < 2"))
    return merge.append_new(o.filter("o_orderkey % 3 <> 0"), batch, ["o_orderkey", "o_custkey"])


SCD1 = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 <> 0 THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS stamp, CASE WHEN c_custkey % 3 <> 0 THEN 'inserted' WHEN c_custkey % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM customer"


@query(SCD1)
def scd1(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = c.filter("c_custkey % 3 = 0").withColumn("stamp", F.lit("2024-01-01").cast("date"))
    batch = c.filter("c_custkey % 2 = 0 or c_custkey % 3 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return merge.scd1(target, batch, "c_custkey", ["c_name"], "stamp", F.lit("2024-01-02").cast("date"))


@query(f"SELECT CAST(count_if(change = 'updated') AS BIGINT) AS updated, CAST(count_if(change = 'unchanged') AS BIGINT) AS unchanged, CAST(count_if(change = 'inserted') AS BIGINT) AS inserted, CAST(count(*) AS BIGINT) AS total FROM ({SCD1})")
def scd1_stats(s, d):
    return merge.change_counts(scd1(s, d))


def history_and_changes(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("state"), "ts")
    first = A.deduplicated(e, ["user_id"], F.col("ts"))
    return first.select("user_id", "state", F.col("ts").alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"), F.lit(True).alias("is_current")), e


VERSIONS = "SELECT user_id, state, ts AS effective_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS effective_to FROM (SELECT user_id, event_type AS state, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR state <> before"


@query(f"SELECT *, effective_to IS NULL AS is_current FROM ({VERSIONS})")
def scd2(s, d):
    history, changes = history_and_changes(s, d)
    return merge.scd2(history, changes, "user_id", ["state"], "ts")


@query("SELECT decision, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN since IS NULL THEN 'NEW' WHEN ts < since THEN 'OUTDATED' WHEN event_type = was THEN 'NO_CHANGE' ELSE 'VALID' END AS decision FROM (SELECT DISTINCT user_id, event_type, ts FROM events) e LEFT JOIN (SELECT user_id AS u, event_type AS was, ts AS since FROM events WHERE user_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) = 1) ON user_id = u) GROUP BY ALL")
def scd2_decisions(s, d):
    """Each event against its user's last one: late ones, equal ones and the last itself. Some users have no history."""
    changes = table(s, d, "events").select("user_id", F.col("event_type").alias("state"), "ts")
    last = A.deduplicated(changes, ["user_id"], F.desc("ts"), F.col("state")).filter("user_id % 5 <> 0")
    history = last.select("user_id", "state", F.col("ts").alias("effective_from"), F.lit(True).alias("is_current"))
    return merge.classified(history, changes, "user_id", ["state"], "ts").groupBy("decision").agg(n())


@query("SELECT user_id, CAST(CASE WHEN user_id % 10 = 0 THEN 0 ELSE 2 END AS BIGINT) AS current FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 10 IN (0, 5)")
def scd2_invariant(s, d):
    """A sound history, in which some users' current versions were lost and others' came twice."""
    history = scd2(s, d).withColumn("is_current", F.col("is_current") & (F.col("user_id") % 10 != 0))
    return merge.current_per_key(history.unionByName(history.filter("user_id % 10 = 5 and is_current")), "user_id")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END, 'unknown') AS label FROM customer")
def first_non_null(s, d):
    c = nulled(s, d)
    return c.select("c_custkey", C.first_of(F.col("c_name"), F.col("c_mktsegment"), F.lit("unknown")).alias("label"))


@query(f"SELECT count_if(c_name IS NULL OR c_custkey IS NULL) = 0 AS no_nulls, 'some' AS columns FROM {NULLED_SQL} UNION ALL SELECT count_if(c_custkey IS NULL) = 0, 'keys' FROM {NULLED_SQL}")
def no_nulls(s, d):
    some, keys = quality.null_check(nulled(s, d), ["c_name", "c_custkey"]), quality.null_check(nulled(s, d), ["c_custkey"])
    return some.withColumn("columns", F.lit("some")).unionByName(keys.withColumn("columns", F.lit("keys")))


DIRTY = {
    "salesperson": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('  ann   lee ', CAST(o_custkey AS STRING), ' ') END",
    "category": "CASE o_orderkey % 3 WHEN 0 THEN 'home electronics' WHEN 1 THEN 'GARDEN' ELSE ' toys ' END",
    "amount": "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS BIGINT) AS STRING) END",
    "region": "CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'east' END",
    "email": "CASE WHEN o_orderkey % 6 = 0 THEN 'nobody' ELSE concat(' C', CAST(o_custkey AS STRING), '@Mail.example') END",
}


@query(
    """SELECT o_orderkey, 'Ann Lee ' || o_custkey AS salesperson, CASE o_orderkey % 3 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Garden' ELSE 'Toys' END AS category, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS DOUBLE) AS amount,
    CAST(o_orderdate AS DATE) AS sale_date, CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE 'East' END AS region, CASE WHEN o_orderkey % 6 <> 0 THEN 'c' || o_custkey || '@mail.example' END AS email
    FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 4 <> 3"""
)
def dirty_sales(s, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    date = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "MM/dd/yyyy")).when(k == 2, F.date_format(t, "dd-MM-yyyy")).otherwise("soon")
    dirty = table(s, d, "orders").select("o_orderkey", *(F.expr(e).alias(c) for c, e in DIRTY.items()), date.alias("sale_date"))
    return cleaning.clean_sales(dirty, categories={"ELECTRONICS": "Electronics"}).select("o_orderkey", "salesperson", "category", "amount", "sale_date", "region", "email")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'S' || CAST(1000000 + c_custkey AS VARCHAR) ELSE 'S' || CAST((SELECT max(CASE WHEN c_custkey % 3 = 0 THEN 1000000 + c_custkey END) FROM customer) + row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey) AS VARCHAR) END AS sid FROM customer")
def surrogate_ids(s, d):
    c = table(s, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN concat('S', CAST(1000000 + c_custkey AS STRING)) WHEN c_custkey % 3 = 1 THEN ' ' END AS sid")
    return cleaning.surrogate_ids(c, "sid", "S", "c_custkey")


@query("SELECT o_orderkey, o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders")
def sql_window(s, d):
    return s.sql("SELECT o_orderkey, o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM {orders}", orders=table(s, d, "orders"))


@query(f"SELECT DISTINCT a.k AS k FROM {SET_A} a JOIN {SET_B} b ON a.k = b.k")
def intersect_by_join(s, d):
    return setops.intersection_by_join(*nation_keys(s, d), ["k"])


@query("SELECT c_custkey, c_name AS name, c_name AS name_2, c_mktsegment FROM customer")
def duplicate_projection(s, d):
    c = table(s, d, "customer")
    return C.distinct_names(c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_name").alias("name"), "c_mktsegment"))


@query("SELECT 'balance' AS missing UNION ALL SELECT 'age'")
def missing_columns(s, d):
    return s.createDataFrame([(x,) for x in C.missing(table(s, d, "customer"), ["C_NAME", "balance", "c_custkey", "age"])], "missing string")


@query("SELECT n_nationkey, n_name, n_comment_right, r_name FROM (SELECT n_nationkey, n_name, n_name || '!' AS n_comment_right, n_regionkey FROM nation) JOIN region ON n_regionkey = r_regionkey")
def join_hygiene(s, d):
    n_ = table(s, d, "nation")
    other = n_.select("n_nationkey", F.concat("n_name", F.lit("!")).alias("n_name"), "n_regionkey")
    out = joins.tidy_join(n_.select("n_nationkey", "n_name"), other, ["n_nationkey"])
    return out.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("n_name_right").alias("n_comment_right"), "r_name")


@query("SELECT event_id, trim(regexp_replace(lower(event_type), '[^a-z]+', ' ', 'g')) AS clean, CAST(length(event_type) AS INT) AS len FROM events")
def text_clean(s, d):
    return table(s, d, "events").select("event_id", F.trim(F.regexp_replace(F.lower("event_type"), "[^a-z]+", " ")).alias("clean"), F.length("event_type").alias("len"))


@query("SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '2024-01-01')::INT AS age_days FROM orders")
def age_on_day(s, d):
    """Days since, by a clock that the caller sets (X11)."""
    return table(s, d, "orders").select("o_orderkey", P.age_days(F.col("o_orderdate"), F.lit("2024-01-01").cast("date")).alias("age_days"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def windowed_events(s, d):
    return windowed_counts(table(s, d, "events"), "ts", ["event_type"])


@query("SELECT id, id % 7 AS g FROM range(1000) t(id)")
def range_source(s, d):
    from ..sources.readers import numbers

    return numbers(s, 1000, g="id % 7")
