"""Tables of requests read out of the given data. Each uses every row of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.network import DAYS, TILE_PINS, destination, grid_point, read


def od_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop-to-stop requests: every logged search."""
    n = read(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), ((F.col("user_id") * 7 + 1) % n).alias("from_id"),
        destination(F.col("event_id"), n).alias("to_id"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map pins: one per supplier."""
    lat, lon = grid_point("s_suppkey", 3571, 2741, TILE_PINS)
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"), lat.alias("lat"), lon.alias("lon"))


def timetable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(c.alias("request_id"), c.alias("timetable_id"))


def stop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(p.alias("request_id"), p.alias("stop_id"))


def each_day(requests: DataFrame) -> DataFrame:
    """The requests once for every day type; request ids become five times the id plus the
    day's place."""
    days = F.array(*(F.lit(d) for d, _ in DAYS.values()))
    return (requests.select("*", F.posexplode(days).alias("_n", "day_type"))
            .withColumn("request_id", F.col("request_id") * len(DAYS) + F.col("_n")).drop("_n"))


def ride_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trip of every schedule: the whole of most, a part of second trips."""
    o, i = F.col("schedule_id"), F.col("trip_index")
    trips = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("schedule_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey") % 4)).alias("trip_index"))
    return trips.select((o * 4 + i).alias("request_id"), o, i, (i % 2).alias("from_seq"),
                        F.when(i == 1, o % 5 + 3).otherwise(F.lit(1 << 40)).alias("to_seq"))


def name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop searches: the start of a stop's name for some, a middle piece for others."""
    s = read(spark, sf_dir, "supplier")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return s.join(p, s.s_suppkey == p.p_partkey).select(
        F.col("s_suppkey").alias("request_id"),
        F.upper(F.substring("p_name", F.lit(1) + (F.col("s_suppkey") % 2).cast("int"),
                            F.lit(3))).alias("q"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place lookup answers: one per customer, under the text ``nation N``."""
    lat, lon = grid_point("c_custkey", 3571, 2741)
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("q"),
        F.col("c_custkey").alias("rank"),
        F.concat_ws(", ", "c_name", "c_mktsegment").alias("display_name"),
        F.when(F.col("c_acctbal") < -950, "n/a").otherwise(lat.cast("string")).alias("lat"),
        lon.cast("string").alias("lon"))
