"""Journey, reachability, trip and connection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connect as X
from ..operators import journeys as J
from ..operators import trips as T
from ..session import stored
from ..sources.network import load
from . import requests as R
from .oracle import hhmm
from .registry import query

_OK = "(dep IS NULL OR arr IS NULL OR arr >= dep)"
_SERVICE = "from_id, to_id, timetable_number, direction_label, day_type"
_LOW = "schedule_id, from_seq, to_seq"

_JOURNEY = {"direct": f"""
    SELECT r.*, v.timetable_id, v.timetable_number, v.direction_label, v.day_type, v.day_label
    FROM ride r JOIN service v ON v.schedule_id = r.schedule_id WHERE {_OK}""",
    "lead": f"""
    SELECT * FROM direct
    QUALIFY row_number() OVER (PARTITION BY {_SERVICE} ORDER BY {_LOW}) = 1"""}


@query(f"""
    SELECT request_id, from_id, to_id,
           CASE WHEN from_id IN (SELECT id FROM stop) AND to_id IN (SELECT id FROM stop)
                THEN 'ok' ELSE 'stop not found' END AS status FROM od""")
def journey_status(spark, sf):
    return J.journey_status(load(spark, sf), R.od_requests(spark, sf))


@query(f"""
    SELECT DISTINCT o.request_id, r.schedule_id, r.from_seq, r.to_seq
    FROM od o JOIN ride r ON r.from_id = o.from_id AND r.to_id = o.to_id WHERE {_OK}""")
def connecting_schedules(spark, sf):
    return J.connecting_schedules(load(spark, sf), R.od_requests(spark, sf))


@query(f"""
    SELECT o.request_id, d.timetable_number, d.direction_label, d.day_type,
           {hhmm('dep')} AS board_time, dep_raw AS board_raw, board_type, board_note AS note_code,
           {hhmm('arr')} AS arrive_time, arr_raw AS arrive_raw, arrive_type, schedule_id, trip_index
    FROM od o JOIN (SELECT * FROM direct QUALIFY row_number() OVER (
        PARTITION BY {_SERVICE}, dep_raw, arr_raw ORDER BY {_LOW}, trip_index) = 1) d
      ON d.from_id = o.from_id AND d.to_id = o.to_id""", _JOURNEY)
def direct_departures(spark, sf):
    return J.journeys(load(spark, sf), R.od_requests(spark, sf)).departures.select(
        "request_id", "timetable_number", "direction_label", "day_type", "board_time", "board_raw",
        "board_type", "note_code", "arrive_time", "arrive_raw", "arrive_type", "schedule_id",
        "trip_index")


@query("""
    SELECT o.request_id, d.timetable_number, d.direction_label, d.day_type, d.day_label,
           CASE d.day_type WHEN 'WEEKDAY' THEN 0 WHEN 'SATURDAY' THEN 1 WHEN 'SUNDAY' THEN 2
                WHEN 'PUBLIC_HOLIDAY' THEN 3 ELSE 9 END AS day_rank
    FROM od o JOIN lead d ON d.from_id = o.from_id AND d.to_id = o.to_id""", _JOURNEY)
def journey_options(spark, sf):
    return J.journeys(load(spark, sf), R.od_requests(spark, sf)).options


@query("""
    SELECT o.request_id, d.timetable_number, d.direction_label, d.day_type, ss.stop_sequence,
           ss.stop_id, s.name, s.lat, s.lon
    FROM od o JOIN lead d ON d.from_id = o.from_id AND d.to_id = o.to_id
    JOIN schedule_stop ss ON ss.schedule_id = d.schedule_id
                         AND ss.stop_sequence BETWEEN d.from_seq AND d.to_seq
    JOIN stop s ON s.id = ss.stop_id""", _JOURNEY)
def journey_segments(spark, sf):
    return J.journeys(load(spark, sf), R.od_requests(spark, sf)).segment_stops


@query("""
    SELECT DISTINCT o.request_id, d.timetable_number, d.direction_label, d.day_type, d.timetable_id
    FROM od o JOIN direct d ON d.from_id = o.from_id AND d.to_id = o.to_id""", _JOURNEY)
def journey_timetables(spark, sf):
    return J.journeys(load(spark, sf), R.od_requests(spark, sf)).timetables


@query("""
    SELECT a.stop_id AS request_id, a.stop_id AS origin_id, b.stop_id, s.name, s.lat, s.lon,
           count(*) AS trip_count, count(DISTINCT v.route_id) AS route_count
    FROM visit a JOIN visit b ON b.schedule_id = a.schedule_id AND b.trip_index = a.trip_index
                             AND b.stop_sequence > a.stop_sequence AND b.stop_id <> a.stop_id
                             AND (a.dep_min IS NULL OR b.dep_min IS NULL OR b.dep_min >= a.dep_min)
    JOIN service v ON v.schedule_id = a.schedule_id JOIN stop s ON s.id = b.stop_id
    GROUP BY a.stop_id, b.stop_id, s.name, s.lat, s.lon""")
def reachable_matrix(spark, sf):
    return J.reachable(load(spark, sf), R.stop_requests(spark, sf))


@query("""
    SELECT a.stop_id AS request_id, a.stop_id AS origin_id, b.stop_id, s.name, s.lat, s.lon,
           count(*) AS trip_count
    FROM visit a JOIN visit b ON b.schedule_id = a.schedule_id AND b.trip_index = a.trip_index
                             AND b.stop_sequence > a.stop_sequence AND b.stop_id <> a.stop_id
    JOIN stop s ON s.id = b.stop_id
    GROUP BY a.stop_id, b.stop_id, s.name, s.lat, s.lon""")
def reachable_untimed(spark, sf):
    return J.reachable_untimed(load(spark, sf), R.stop_requests(spark, sf))


@query(f"""
    SELECT o.request_id, o.from_id, o.to_id, o.want AS day_type, {hhmm('min(dep)')} AS earliest,
           count(*) AS trip_count
    FROM (SELECT *, CASE request_id % 4 WHEN 0 THEN 'WEEKDAY' WHEN 1 THEN 'SATURDAY' END AS want
          FROM od) o
    JOIN ride r ON r.from_id = o.from_id AND r.to_id = o.to_id
    JOIN service v ON v.schedule_id = r.schedule_id
    WHERE o.want IS NULL OR v.day_type = o.want
    GROUP BY o.request_id, o.from_id, o.to_id, o.want""")
def direct_service(spark, sf):
    """A day is asked for by half of the requests, any day by the rest."""
    i = F.col("request_id") % 4
    req = R.od_requests(spark, sf).withColumn(
        "day_type", F.when(i == 0, "WEEKDAY").when(i == 1, "SATURDAY"))
    return J.direct_service(load(spark, sf), req)


# Every trip of every schedule: the whole of most, a part of second trips.
ASKED_RIDES = {"asked": """
    SELECT 4 * schedule_id + trip_index AS request_id, schedule_id, trip_index,
           trip_index % 2 AS from_seq,
           CASE WHEN trip_index = 1 THEN schedule_id % 5 + 3 ELSE 1099511627776 END AS to_seq
    FROM trip"""}


@query(f"""
    SELECT request_id, stop_sequence, coalesce(arg_min_next, arg_max_last) AS travel_key, stop_id,
           name, lat, lon, raw_value, cell_type, {hhmm('dep_min')} AS departure_time
    FROM (SELECT a.request_id, c.*, s.name, s.lat, s.lon,
            first_value(dep_min IGNORE NULLS) OVER (PARTITION BY a.request_id ORDER BY stop_sequence
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS arg_min_next,
            last_value(dep_min IGNORE NULLS) OVER (PARTITION BY a.request_id ORDER BY stop_sequence
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS arg_max_last
          FROM asked a JOIN visit c ON c.schedule_id = a.schedule_id AND c.trip_index = a.trip_index
                                   AND c.stop_sequence BETWEEN a.from_seq AND a.to_seq
          JOIN stop s ON s.id = c.stop_id)""", ASKED_RIDES)
def trip_travel_order(spark, sf):
    return T.trip_stops(load(spark, sf), R.ride_requests(spark, sf))


@query("""
    SELECT DISTINCT a.request_id, a.schedule_id, a.trip_index, n.code, n.description
    FROM asked a JOIN stop_time c ON c.schedule_id = a.schedule_id AND c.trip_index = a.trip_index
    JOIN schedule sc ON sc.id = a.schedule_id
    JOIN timetable_note n ON n.timetable_id = sc.timetable_id AND n.code = c.note_code""", ASKED_RIDES)
def trip_notes(spark, sf):
    return T.trip_notes(load(spark, sf), R.ride_requests(spark, sf))


@query("""
    SELECT o.request_id, a.e AS x FROM od o JOIN onward a ON a.s = o.from_id
    JOIN onward b ON b.e = o.to_id AND b.s = a.e""")
def interchanges(spark, sf):
    return X.interchanges(load(spark, sf), R.od_requests(spark, sf))


@query("""
    SELECT o.request_id, m.x, m.y FROM od o
    JOIN middle m ON m.from_id = o.from_id AND m.to_id = o.to_id""")
def middle_pairs(spark, sf):
    return X.middle_pairs(load(spark, sf), R.od_requests(spark, sf))


_LEG = "s AS from_id, e AS to_id, day_type, route, ttn, dep, dep_raw, arr, arr_raw, sched, trip, from_seq, to_seq"
_LEG_COLS = ["from_id", "to_id", "day_type", "route", "ttn", "dep", "dep_raw", "arr", "arr_raw",
             "sched", "trip", "from_seq", "to_seq"]


@query(f"SELECT {_LEG} FROM leg1")
def first_legs(spark, sf):
    t, od = load(spark, sf), R.od_requests(spark, sf)
    pairs = X.onward(t, od).withColumnRenamed("x", "to_id")
    return X.first_legs(t, pairs).select(*_LEG_COLS)


@query(f"SELECT {_LEG} FROM leg5")
def middle_legs(spark, sf):
    t, od = load(spark, sf), R.od_requests(spark, sf)
    pairs = X.middle_pairs(t, od).select(F.col("x").alias("from_id"), F.col("y").alias("to_id"))
    # Written: origins, destinations and pairs are each read of them, and they are dear to work out.
    return X.middle_legs(t, stored(pairs.distinct(), "middle_pairs")).select(*_LEG_COLS)


@query(f"SELECT {_LEG} FROM leg9")
def last_legs(spark, sf):
    t, od = load(spark, sf), R.od_requests(spark, sf)
    pairs = X.backward(t, od).withColumnRenamed("x", "from_id")
    return X.last_legs(t, pairs).select(*_LEG_COLS)


_TWO_COLS = ["day_type", "x", "route1", "ttn1", "dep_raw1", "dep1", "arr1", "sched1", "trip1",
             "from_seq1", "to_seq1", "route2", "ttn2", "dep2", "arr_raw2", "sched2", "trip2",
             "from_seq2", "to_seq2", "wait_minutes", "total_minutes"]
_THREE_COLS = [*_TWO_COLS[:2], "y", *_TWO_COLS[2:14], "arr2", *_TWO_COLS[15:19], "route3", "ttn3",
               "dep3", "arr_raw3", "sched3", "trip3", "from_seq3", "to_seq3", "wait_minutes",
               "total_minutes"]


@query(f"""SELECT from_id, to_id, CAST(n AS INTEGER) AS n, {', '.join(_TWO_COLS)} FROM two""")
def two_leg_connections(spark, sf):
    pairs = R.od_requests(spark, sf).select("from_id", "to_id").distinct()
    return X.two_bus(load(spark, sf), pairs, 10, 6).select(
        "from_id", "to_id", F.col("_rank").alias("n"), *_TWO_COLS)


@query(f"""SELECT from_id, to_id, CAST(n AS INTEGER) AS n, {', '.join(_THREE_COLS)} FROM three""")
def three_leg_connections(spark, sf):
    t = load(spark, sf)
    pairs = R.od_requests(spark, sf).select("from_id", "to_id").distinct()
    rest = stored(pairs.join(X.two_bus(t, pairs, 10, 1).select("from_id", "to_id"),
                             ["from_id", "to_id"], "left_anti"), "unconnected")
    return X.three_bus(t, rest, 10, 6).select(
        "from_id", "to_id", F.col("_rank").alias("n"), *_THREE_COLS)


def _leg_sql(src, k, i, frm, to):
    board = "dep_raw1" if i == 1 else hhmm(f"dep{i}")
    arrive = f"arr_raw{k}" if i == k else hhmm(f"arr{i}")
    minutes = "CAST(NULL AS INTEGER)" if i == k else f"arr{i}"
    return f"""
        SELECT from_id, to_id, {k} AS legs_required, CAST(n AS INTEGER) AS connection_no,
               {i} AS leg_no, day_type, wait_minutes, total_minutes, {frm} AS from_stop_id,
               {to} AS to_stop_id, route{i} AS route_label, ttn{i} AS timetable_number,
               {board} AS board_raw, {arrive} AS arrive_raw, dep{i} AS board_minutes,
               {minutes} AS arrive_minutes, sched{i} AS schedule_id, trip{i} AS trip_index,
               from_seq{i} AS from_seq, to_seq{i} AS to_seq FROM {src}"""


EVERY_LEG = {"every": " UNION ALL ".join([
    _leg_sql("two", 2, 1, "from_id", "x"), _leg_sql("two", 2, 2, "x", "to_id"),
    _leg_sql("three", 3, 1, "from_id", "x"), _leg_sql("three", 3, 2, "x", "y"),
    _leg_sql("three", 3, 3, "y", "to_id")])}


@query("""
    SELECT o.request_id, e.legs_required, e.connection_no, e.leg_no, e.day_type, e.wait_minutes,
           e.total_minutes, e.from_stop_id, a.name AS from_name, a.lat AS from_lat,
           a.lon AS from_lon, e.to_stop_id, b.name AS to_name, b.lat AS to_lat, b.lon AS to_lon,
           e.route_label, e.timetable_number, e.board_raw, e.arrive_raw, e.board_minutes,
           e.arrive_minutes, e.schedule_id, e.trip_index, e.from_seq, e.to_seq
    FROM od o JOIN every e ON e.from_id = o.from_id AND e.to_id = o.to_id
    JOIN stop a ON a.id = e.from_stop_id JOIN stop b ON b.id = e.to_stop_id""", EVERY_LEG)
def connections_cascade(spark, sf):
    return X.connections(load(spark, sf), R.od_requests(spark, sf)).legs


@query("""
    SELECT o.request_id, o.from_id, o.to_id, 'ok' AS status, CAST(k AS INTEGER) AS legs_required,
           coalesce(n, 0) AS connection_count
    FROM od o LEFT JOIN (
        SELECT from_id, to_id, 2 AS k, count(*) AS n FROM two GROUP BY from_id, to_id
        UNION ALL SELECT from_id, to_id, 3, count(*) FROM three GROUP BY from_id, to_id) f
      ON f.from_id = o.from_id AND f.to_id = o.to_id""")
def connection_status(spark, sf):
    return X.connections(load(spark, sf), R.od_requests(spark, sf)).status
