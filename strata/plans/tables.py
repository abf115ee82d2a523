"""The roles that the driver's tables play: events are boardings, change log and stream; orders are trips of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE_DAY = "2024-01-31"
#: Order lines that one task sorts at most, about, when they meet their orders.
TRIP_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k (the number in props), zone and day."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").withColumn("k", k).withColumn("zone", F.col("k") % 26).withColumn("day", F.to_date("ts"))


EV = """ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 26 AS zone, CAST(ts AS DATE) AS day FROM events)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, commit_ts, op, card, profile, area: a DELETE has no body."""
    e = events(spark, sf_dir)
    op = F.when(F.col("event_type") == "signup", "INSERT").when((F.col("event_type") == "error") & (F.col("k") < 2), "DELETE").otherwise("UPDATE")
    body = op != "DELETE"
    return e.select(F.col("event_id").alias("seq"), F.col("ts").alias("commit_ts"), op.alias("op"), F.col("user_id").alias("card"), F.when(body, F.col("event_type")).alias("profile"), F.when(body, F.col("zone")).alias("area"))


LOG = EV + """, ops AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'INSERT' WHEN event_type = 'error' AND k < 2 THEN 'DELETE' ELSE 'UPDATE' END AS op FROM ev),
log AS (SELECT event_id AS seq, ts AS commit_ts, op, user_id AS card, CASE WHEN op <> 'DELETE' THEN event_type END AS profile, CASE WHEN op <> 'DELETE' THEN zone END AS area FROM ops)"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as origin-destination trips; a line shipped before its order has no exit."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = l.count() // TRIP_ROWS + 1
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        o, l = o.repartition(parts, "o_orderkey"), l.repartition(parts, "l_orderkey")
    there = F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("leg"), F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("entry"), there.alias("exit"), F.col("l_suppkey").alias("station"), F.col("l_extendedprice").alias("fare"))


TRIPS = """trips AS (SELECT l_orderkey AS trip, l_linenumber AS leg, o_custkey AS person, o_orderdate AS entry,
  CASE WHEN l_shipdate >= o_orderdate THEN l_shipdate END AS exit, l_suppkey AS station, l_extendedprice AS fare
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
