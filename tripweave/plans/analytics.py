"""Search analytics, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..session import run_folder
from ..sources.network import load
from ..streaming import searches as S
from .registry import query


@query("""
    SELECT id, endpoint, from_kind, from_stop_id, from_lat, from_lon, 'stop' AS to_kind, to_stop_id,
           option_count, duration_ms, strftime(searched_at, '%Y-%m-%d %H:%M:%S') AS searched_at
    FROM search_analytics""")
def search_rows(spark, sf):
    """Events turned into search rows; they carry their options as an array."""
    return A.event_rows(_events(load(spark, sf))).select(
        "id", "endpoint", "from_kind", "from_stop_id", "from_lat", "from_lon", "to_kind", "to_stop_id",
        "option_count", "duration_ms",
        F.date_format("searched_at", "yyyy-MM-dd HH:mm:ss").alias("searched_at"))


def _events(t):
    """The derived searches in the shape the feed delivers them."""
    base = F.coalesce("from_stop_id", F.lit(0))
    option = F.transform(F.sequence(F.lit(1), F.col("option_count")), lambda i: F.struct(
        F.lpad(((base + i) % 400).cast("string"), 6, "0").alias("timetable_number"),
        F.concat(F.lit("LINE "), ((base + i) % 400).cast("string")).alias("route_label"),
        F.lit("WEEKDAY").alias("day_type"), i.alias("departure_count")))
    return t.search_analytics.select(
        F.col("id").alias("event_id"), "endpoint", "from_stop_id", "from_lat", "from_lon",
        "to_stop_id", "to_lat", "to_lon",
        F.when(F.col("option_count") > 0, option).otherwise(F.slice(option, 1, 0)).alias("options"),
        "duration_ms", "searched_at")


@query("""
    SELECT search_id, timetable_number, route_label, day_type, departure_count
    FROM search_analytics_option""")
def option_rows(spark, sf):
    return A.option_rows(_events(load(spark, sf)))


@query("""
    SELECT route_label, timetable_number, day_type, count(DISTINCT search_id) AS searches,
           CAST(sum(departure_count) AS BIGINT) AS departures_offered
    FROM search_analytics_option GROUP BY route_label, timetable_number, day_type
    ORDER BY searches DESC, route_label, timetable_number, day_type LIMIT 20""")
def route_demand(spark, sf):
    return A.route_demand(load(spark, sf))


_NAMES = """coalesce(a.name, 'dropped pin') AS origin, coalesce(b.name, 'dropped pin') AS destination"""
_JOINS = """search_analytics x LEFT JOIN stop a ON a.id = x.from_stop_id
            LEFT JOIN stop b ON b.id = x.to_stop_id"""


@query(f"""
    SELECT {_NAMES}, count(*) AS searches,
           CAST((20 * sum(option_count) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS avg_results
    FROM {_JOINS} GROUP BY origin, destination
    ORDER BY searches DESC, origin, destination LIMIT 20""")
def popular_pairs(spark, sf):
    return A.popular_pairs(load(spark, sf))


@query(f"""
    SELECT {_NAMES}, count(*) AS failed_searches FROM {_JOINS} WHERE option_count = 0
    GROUP BY origin, destination ORDER BY failed_searches DESC, origin, destination LIMIT 20""")
def unmet_demand(spark, sf):
    return A.unmet_demand(load(spark, sf))


@query(f"""
    SELECT coalesce(a.name, 'pin ' || printf('%.3f', round(x.from_lat, 3)) || ','
                    || printf('%.3f', round(x.from_lon, 3))) AS origin,
           b.name AS destination, count(*) AS failed_searches
    FROM {_JOINS} WHERE option_count = 0 GROUP BY origin, destination""")
def unmet_demand_pins(spark, sf):
    return A.unmet_demand(load(spark, sf), by_pin=True, limit=None)


@query("""
    SELECT strftime(date_trunc('hour', searched_at), '%Y-%m-%d %H:00') AS hour, count(*) AS searches
    FROM search_analytics GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def searches_per_hour(spark, sf):
    return A.searches_per_hour(load(spark, sf)).select(
        F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "searches")


@query("""
    SELECT endpoint, from_kind AS searched_from, count(*) AS searches,
           CAST((20 * sum(option_count) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS avg_results,
           CAST((2 * sum(duration_ms) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_milliseconds
    FROM search_analytics GROUP BY endpoint, from_kind""")
def endpoint_cost(spark, sf):
    return A.endpoint_cost(load(spark, sf))


def _feed(spark, sf):
    """The searches as a folder of event files, and a fresh folder for stream state."""
    root = f"{run_folder(spark)}/feed-{uuid.uuid4().hex}"
    events = _events(load(spark, sf))
    # Out of order, over more files than a batch takes, and a third of it delivered twice.
    again = events.filter("event_id % 3 = 0")
    events.unionByName(again).repartition(150, F.hash("event_id")).write.parquet(f"{root}/in")
    return root, S.event_stream(spark, f"{root}/in")


def _recorded(spark, sf):
    root, events = _feed(spark, sf)
    S.record_searches(events, f"{root}/out", f"{root}/state").awaitTermination()
    return S.recorded(spark, f"{root}/out")


@query("""
    SELECT strftime(date_trunc('hour', searched_at), '%Y-%m-%d %H:00') AS hour, count(*) AS searches
    FROM search_analytics GROUP BY 1""")
def searches_per_hour_stream(spark, sf):
    """Every hour of the feed once it is drained."""
    return A.searches_per_hour(_recorded(spark, sf), limit=None).select(
        F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "searches")


@query("""
    SELECT route_label, timetable_number, day_type, count(DISTINCT search_id) AS searches,
           CAST(sum(departure_count) AS BIGINT) AS departures_offered
    FROM search_analytics_option GROUP BY route_label, timetable_number, day_type""")
def route_demand_stream(spark, sf):
    return A.route_demand(_recorded(spark, sf), limit=None)


@query("SELECT search_id, route_label, departure_count FROM search_analytics_option")
def recorded_options_stream(spark, sf):
    """Option rows as recorded by the stream sink."""
    return _recorded(spark, sf).search_analytics_option.select(
        "search_id", "route_label", "departure_count")
