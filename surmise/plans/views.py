"""Relations over the tables of a star schema, as DataFrames and as the SQL that defines the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surmise.sources.facts import relation as _relation


def relation(df: DataFrame) -> DataFrame:
    """Rows with a null cell aren't tuples of a view: SQL's joins and comparisons leave them out too."""
    return _relation(df, nulls="drop")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nation_in(spark: SparkSession, d: str) -> DataFrame:
    n, r = _table(spark, d, "nation"), _table(spark, d, "region")
    return relation(n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name"))


def region_name(spark: SparkSession, d: str) -> DataFrame:
    return relation(_table(spark, d, "region").select("r_name"))


def part_of(spark: SparkSession, d: str) -> DataFrame:
    c, n = _table(spark, d, "customer"), _table(spark, d, "nation")
    below = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("v0"), F.col("n_name").alias("v1"))
    return relation(below.unionByName(nation_in(spark, d)))


def supplies(spark: SparkSession, d: str) -> DataFrame:
    return relation(_table(spark, d, "lineitem").select("l_suppkey", "l_partkey"))


def follows(spark: SparkSession, d: str) -> DataFrame:
    """Who buys next after whom: within each day, and from a day's last purchase to the next day's first (one row a day)."""
    e = _table(spark, d, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day"), "ts", "event_id", "user_id")
    after = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    at = F.struct("ts", "event_id", "user_id")
    days = e.groupBy("day").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    over_night = days.select(F.col("last.user_id").alias("user_id"), F.lead("first.user_id").over(Window.orderBy("day")).alias("next_id"))
    return relation(e.select("user_id", after.alias("next_id")).unionByName(over_night))


def next_turn(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations").select("conv_id", "turn")
    later = c.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    return relation(c.join(later, (F.col("conv_id") == F.col("c")) & (F.col("t") == F.col("turn") + 1)).select("conv_id", "turn", "t"))


def _sold(spark: SparkSession, d: str, lines) -> DataFrame:
    li = _table(spark, d, "lineitem").where(lines).select("l_orderkey", "l_partkey")
    o, c = _table(spark, d, "orders").select("o_orderkey", "o_custkey"), _table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, p = _table(spark, d, "nation").select("n_nationkey", "n_name"), _table(spark, d, "part").select("p_partkey", "p_brand")
    df = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return relation(df.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("n_name", "p_brand"))


def bulk(spark: SparkSession, d: str) -> DataFrame:
    return _sold(spark, d, "l_quantity >= 50 AND l_discount >= 0.1")


def returned(spark: SparkSession, d: str) -> DataFrame:
    return _sold(spark, d, "l_quantity >= 49 AND l_returnflag = 'R' AND l_discount >= 0.09")


def part_name(spark: SparkSession, d: str) -> DataFrame:
    return relation(_table(spark, d, "part").select("p_name"))


def brand(spark: SparkSession, d: str) -> DataFrame:
    return relation(_table(spark, d, "part").select("p_brand"))


VIEWS = {f.__name__: f for f in (nation_in, region_name, part_of, supplies, follows, next_turn, bulk, returned, part_name, brand)}

_SOLD = "SELECT DISTINCT n_name x, p_brand y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE "
SQL = {
    "nation_in": "SELECT DISTINCT n_name x, r_name y FROM nation JOIN region ON n_regionkey = r_regionkey",
    "region_name": "SELECT DISTINCT r_name x FROM region",
    "part_of": "SELECT 'C' || c_custkey x, n_name y FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "supplies": "SELECT DISTINCT l_suppkey::BIGINT x, l_partkey::BIGINT y FROM lineitem",
    "follows": "SELECT DISTINCT a::BIGINT x, b::BIGINT y FROM (SELECT user_id a, LEAD(user_id) OVER (ORDER BY ts, event_id) b FROM events WHERE event_type = 'purchase') WHERE b IS NOT NULL",
    "next_turn": "SELECT DISTINCT a.conv_id::BIGINT c, a.turn::BIGINT x, b.turn::BIGINT y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "bulk": _SOLD + "l_quantity >= 50 AND l_discount >= 0.1",
    "returned": _SOLD + "l_quantity >= 49 AND l_returnflag = 'R' AND l_discount >= 0.09",
    "part_name": "SELECT DISTINCT p_name x FROM part",
    "brand": "SELECT DISTINCT p_brand x FROM part",
}


def with_views(names, body: str, recursive: str = "") -> str:
    """``body`` under the named views, and a recursive one if given."""
    views = [f"{n} AS ({SQL[n]})" for n in names]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*views, recursive] if recursive else views)} {body}"
