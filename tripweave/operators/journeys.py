"""Direct journeys and one-bus reachability between named stops.

Each distinct question is worked out once and the answer joined back to every request
that asked it, so repeated requests cost one lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clock, day_rank, ordered_or_untimed
from ..sources.tables import Tables
from .blocks import first_per

PAIR = ["from_id", "to_id"]
SERVICE = ["timetable_number", "direction_label", "day_type"]


def schedule_service(t: Tables) -> DataFrame:
    """Schedules with the timetable number and route they run under."""
    tt = t.timetable.select(F.col("id").alias("timetable_id"), "timetable_number", "route_id")
    return (t.schedule.select(F.col("id").alias("schedule_id"), "timetable_id", "direction_label",
                              "day_type", "day_label").join(tt, "timetable_id"))


def journey_status(t: Tables, requests: DataFrame) -> DataFrame:
    """``ok``, or ``stop not found`` when either end is unknown."""
    a = t.stop.select(F.col("id").alias("from_id"), F.lit(True).alias("a"))
    b = t.stop.select(F.col("id").alias("to_id"), F.lit(True).alias("b"))
    return (requests.select("request_id", *PAIR).join(a, "from_id", "left").join(b, "to_id", "left")
            .select("request_id", *PAIR, F.when(F.col("a") & F.col("b"), "ok")
                    .otherwise("stop not found").alias("status")))


def _shared_schedules(t: Tables, pairs: DataFrame) -> DataFrame:
    """Schedules listing both stops of a pair, the second later.

    Wanted origins and destinations meet on the schedules they share before pairs are looked
    at, so a busy stop's schedules are never multiplied by the pairs that ask for it.
    """
    a = t.schedule_stop.select(F.col("stop_id").alias("from_id"), "schedule_id",
                               F.col("stop_sequence").alias("from_seq"))
    b = t.schedule_stop.select(F.col("stop_id").alias("to_id"), "schedule_id",
                               F.col("stop_sequence").alias("to_seq"))
    met = (a.join(pairs.select("from_id").distinct(), "from_id", "left_semi")
           .join(b.join(pairs.select("to_id").distinct(), "to_id", "left_semi"), "schedule_id")
           .filter("to_seq > from_seq"))
    return met.join(pairs.select(*PAIR), PAIR)


def pair_rides(t: Tables, pairs: DataFrame) -> DataFrame:
    """Trips serving both stops of a pair, the second later on the page.

    The match runs on schedules first and fetches cells only for those that connect.
    """
    cells = t.visit.select("schedule_id", "trip_index", "stop_sequence", "cell_type", "dep_min",
                           "note_code", "raw_value")

    def end(p, seq):
        return cells.select("schedule_id", "trip_index", F.col("stop_sequence").alias(seq),
                            *[F.col(c).alias(f"{p}_{c}") for c in
                              ("cell_type", "dep_min", "note_code", "raw_value")])
    return (_shared_schedules(t, pairs)
            .join(end("board", "from_seq"), ["schedule_id", "from_seq"])
            .join(end("arrive", "to_seq"), ["schedule_id", "trip_index", "to_seq"]))


def connecting_schedules(t: Tables, requests: DataFrame) -> DataFrame:
    """Schedules on which some trip takes a request from its first stop to its second."""
    pairs = requests.select(*PAIR).distinct()
    found = (pair_rides(t, pairs)
             .filter(ordered_or_untimed("board_dep_min", "arrive_dep_min"))
             .select(*PAIR, "schedule_id", "from_seq", "to_seq").distinct())
    return (requests.select("request_id", *PAIR).join(found, PAIR)
            .select("request_id", "schedule_id", "from_seq", "to_seq"))


@dataclass
class Journeys:
    """Direct journeys as flat tables sharing (request_id, service) keys."""

    options: DataFrame
    departures: DataFrame
    segment_stops: DataFrame
    timetables: DataFrame
    status: DataFrame


def journeys(t: Tables, requests: DataFrame) -> Journeys:
    """Direct single-bus journeys, merged by service across timetable versions.

    Within a service, departures with the same printed board and arrive text count once.
    The lowest schedule supplies the segment and the day label.
    """
    req = requests.select("request_id", *PAIR)
    rides = (pair_rides(t, req.select(*PAIR).distinct())
             .filter(ordered_or_untimed("board_dep_min", "arrive_dep_min"))
             .join(schedule_service(t), "schedule_id"))
    key = [*PAIR, *SERVICE]

    departures = first_per(rides, [*key, "board_raw_value", "arrive_raw_value"],
                           ["schedule_id", "from_seq", "to_seq", "trip_index"])
    lead = first_per(rides.select(*key, "day_label", "schedule_id", "from_seq", "to_seq"),
                     key, ["schedule_id", "from_seq", "to_seq"])
    st = t.stop.select(F.col("id").alias("stop_id"), "name", "lat", "lon")
    inside = (lead.select(*key, "schedule_id", "from_seq", "to_seq")
              .join(t.schedule_stop, "schedule_id")
              .filter(F.col("stop_sequence").between(F.col("from_seq"), F.col("to_seq")))
              .join(st, "stop_id"))

    def asked(df, *cols):
        return req.join(df, PAIR).select("request_id", *SERVICE, *cols)

    return Journeys(
        options=asked(lead.withColumn("day_rank", day_rank("day_type")), "day_label", "day_rank"),
        departures=asked(
            departures, clock("board_dep_min").alias("board_time"),
            F.col("board_raw_value").alias("board_raw"),
            F.col("board_cell_type").alias("board_type"), F.col("board_note_code").alias("note_code"),
            clock("arrive_dep_min").alias("arrive_time"),
            F.col("arrive_raw_value").alias("arrive_raw"),
            F.col("arrive_cell_type").alias("arrive_type"), "schedule_id", "trip_index"),
        segment_stops=asked(inside, "stop_sequence", "stop_id", "name", "lat", "lon"),
        timetables=asked(rides.select(*key, "timetable_id").distinct(), "timetable_id"),
        status=journey_status(t, req))


def _downstream(t: Tables, origins: DataFrame, guarded: bool) -> DataFrame:
    """Cells later on the trips that serve each origin stop, the origin itself left out."""
    # Origins pick rows of schedules, which are fewer and narrower than cells; cells stay in place.
    rows = t.schedule_stop.select(F.col("stop_id").alias("origin_id"), "schedule_id", F.col(
        "stop_sequence").alias("at_seq")).join(origins, "origin_id", "left_semi")
    here = t.visit.select(F.col("stop_id").alias("origin_id"), "schedule_id", "trip_index",
                          F.col("stop_sequence").alias("at_seq"), F.col("dep_min").alias("at_min"))
    later = t.visit.select("schedule_id", "trip_index", "stop_sequence", "stop_id", "dep_min")
    out = (here.join(rows, ["schedule_id", "at_seq", "origin_id"], "left_semi").join(later, ["schedule_id", "trip_index"])
           .filter("stop_sequence > at_seq AND stop_id <> origin_id"))
    return out.filter(ordered_or_untimed("at_min", "dep_min")) if guarded else out


def reachable(t: Tables, requests: DataFrame) -> DataFrame:
    """Stops reachable from a stop on one bus: trips and distinct routes to each.

    Trips are counted per (origin, stop, route) first; what meets at one (origin, stop)
    is then one row per route.
    """
    origins = requests.select(F.col("stop_id").alias("origin_id")).distinct()
    sv = schedule_service(t).select("schedule_id", "route_id")
    per_schedule = (_downstream(t, origins, guarded=True)
                    .groupBy("origin_id", "stop_id", "schedule_id")
                    .agg(F.count(F.lit(1)).alias("n")))
    per_route = (per_schedule.join(sv, "schedule_id").groupBy("origin_id", "stop_id", "route_id")
                 .agg(F.sum("n").alias("n")))
    found = per_route.groupBy("origin_id", "stop_id").agg(
        F.sum("n").alias("trip_count"), F.count("route_id").alias("route_count"))
    return _name_reached(t, requests, found, "route_count")


def reachable_untimed(t: Tables, requests: DataFrame) -> DataFrame:
    """As ``reachable`` but with no check of times, and trips counted only."""
    origins = requests.select(F.col("stop_id").alias("origin_id")).distinct()
    found = (_downstream(t, origins, guarded=False).groupBy("origin_id", "stop_id")
             .agg(F.count(F.lit(1)).alias("trip_count")))
    return _name_reached(t, requests, found)


def _name_reached(t, requests, found, *extra):
    st = t.stop.select(F.col("id").alias("stop_id"), "name", "lat", "lon")
    asked = requests.select("request_id", F.col("stop_id").alias("origin_id"))
    return (asked.join(found.join(st, "stop_id"), "origin_id")
            .select("request_id", "origin_id", "stop_id", "name", "lat", "lon", "trip_count", *extra))


def direct_service(t: Tables, requests: DataFrame) -> DataFrame:
    """Trips and earliest published departure between two stops, optionally on one day.

    Requests hold (from_id, to_id, day_type or null). Times are not compared.
    """
    keys = [*PAIR, "want_day"]
    asked = requests.select("request_id", *PAIR, F.col("day_type").alias("want_day"))
    sc = t.schedule.select(F.col("id").alias("schedule_id"), "day_type")
    per_day = (pair_rides(t, asked.select(*PAIR).distinct()).join(sc, "schedule_id")
               .groupBy(*PAIR, "day_type")
               .agg(F.min("board_dep_min").alias("m"), F.count(F.lit(1)).alias("n")))
    found = (asked.select(*keys).distinct().join(per_day, PAIR)
             .filter("want_day IS NULL OR want_day = day_type")
             .groupBy(*keys).agg(F.min("m").alias("m"), F.sum("n").alias("trip_count")))
    found = found.select(F.col("from_id").alias("f"), F.col("to_id").alias("g"),
                         F.col("want_day").alias("d"), "m", "trip_count")
    same = (F.col("from_id") == F.col("f")) & (F.col("to_id") == F.col("g")) & (
        F.col("want_day").eqNullSafe(F.col("d")))
    return asked.join(found, same).select(
        "request_id", *PAIR, F.col("want_day").alias("day_type"), clock("m").alias("earliest"),
        "trip_count")
