"""Catalogue lookups: routes, timetables, stops, boards and printed grids.

Every lookup takes a table of requests and returns flat rows with ``request_id`` first.
Nested payloads are given as ordered rows, so that no timetable has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CORE_DAYS, DAY_ORDER, clock, day_rank, iso_date
from ..sources.tables import Tables
from .blocks import first_per, top_per
from .names import NameIndex, index_names


def health(t: Tables) -> DataFrame:
    """Row counts of the three main tables, one row each."""
    out = None
    for name in ("route", "timetable", "stop"):
        one = getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def route_names(t: Tables) -> NameIndex:
    return t.kept("route names", lambda: index_names(t.route.select("id", "name"), "name"))


def stop_names(t: Tables) -> NameIndex:
    return t.kept("stop names", lambda: index_names(
        t.stop.select(F.col("id").alias("stop_id"), "name"), "name"))


def area_names(t: Tables) -> NameIndex:
    return t.kept("area names", lambda: index_names(areas(t), "area"))


def search_routes(t: Tables, requests: DataFrame) -> DataFrame:
    """Routes whose name contains ``q`` (any case) and whose letter is ``letter``.

    Either filter may be null. Timetables are counted before they meet the requests.
    """
    counts = (t.timetable.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
              .withColumnRenamed("route_id", "id"))
    routes = (t.route.join(counts, "id", "left")
              .select("id", "name", "origin", "destination", "letter_group",
                      F.coalesce("n", F.lit(0)).alias("timetable_count")))
    asked = requests.select("request_id", F.coalesce("q", F.lit("")).alias("q"),
                            F.upper(F.nullif("letter", F.lit(""))).alias("letter"))
    hits = route_names(t).find(asked).select("q", "id")
    return (asked.join(hits, "q").join(routes, "id")
            .filter("letter IS NULL OR letter_group = letter")
            .select("request_id", *routes.columns))


def route_detail(t: Tables, requests: DataFrame) -> DataFrame:
    """Timetables of a route in (holiday, number, start) order; ``status`` for unknown ids."""
    r = t.route.select(F.col("id").alias("route_id"), F.col("name").alias("route_name"),
                       "origin", "destination", "letter_group")
    tt = t.timetable.select(
        "route_id", F.col("id").alias("timetable_id"), "timetable_number", "is_public_holiday",
        iso_date("effective_from").alias("effective_from"),
        iso_date("effective_to").alias("effective_to"), "pdf_filename", "pdf_url",
        "page_count", "parse_status")
    return (requests.select("request_id", "route_id").join(r, "route_id", "left")
            .withColumn("status", F.when(F.col("route_name").isNull(), "route not found")
                        .otherwise("ok"))
            .join(tt, "route_id", "left")
            .select("request_id", "status", "route_id", "route_name", "origin", "destination",
                    "letter_group", *tt.columns[1:]))


def route_detail_order() -> list:
    return ["request_id", "is_public_holiday", "timetable_number",
            F.asc_nulls_last("effective_from"), "timetable_id"]


def timetable_header(t: Tables, requests: DataFrame) -> DataFrame:
    r = t.route.select(F.col("id").alias("route_id"), F.col("name").alias("route_name"))
    return (requests.select("request_id", "timetable_id")
            .join(t.timetable.withColumnRenamed("id", "timetable_id"), "timetable_id")
            .join(r, "route_id")
            .select("request_id", "timetable_id", "timetable_number", "is_public_holiday",
                    iso_date("effective_from").alias("effective_from"),
                    iso_date("effective_to").alias("effective_to"), "pdf_filename", "pdf_url",
                    "page_count", "route_id", "route_name"))


def timetable_notes(t: Tables, requests: DataFrame) -> DataFrame:
    return (requests.select("request_id", "timetable_id")
            .join(t.timetable_note, "timetable_id")
            .select("request_id", "timetable_id", "code", "description"))


def timetable_schedules(t: Tables, requests: DataFrame) -> DataFrame:
    """Schedules of a timetable; sort by page, direction, ``day_rank`` and id."""
    sc = t.schedule.withColumnRenamed("id", "schedule_id")
    return (requests.select("request_id", "timetable_id").join(sc, "timetable_id")
            .select("request_id", "timetable_id", "schedule_id", "page_number",
                    "direction_index", "direction_label", "day_type",
                    day_rank("day_type", other=4).alias("day_rank"), "day_label",
                    "section_timetable_number", "no_service"))


def timetable_stops(t: Tables, requests: DataFrame) -> DataFrame:
    st = t.stop.select(F.col("id").alias("stop_id"), "name", "lat", "lon")
    return (timetable_schedules(t, requests).select("request_id", "timetable_id", "schedule_id")
            .join(t.schedule_stop, "schedule_id").join(st, "stop_id")
            .select("request_id", "timetable_id", "schedule_id", "stop_sequence", "name",
                    "lat", "lon"))


def timetable_trips(t: Tables, requests: DataFrame) -> DataFrame:
    return (timetable_schedules(t, requests).select("request_id", "timetable_id", "schedule_id")
            .join(t.trip, "schedule_id")
            .select("request_id", "timetable_id", "schedule_id", "trip_index"))


def timetable_cells(t: Tables, requests: DataFrame) -> DataFrame:
    """Every cell of a timetable with its schedule's display position.

    This is the whole timetable payload in long form: sort by page, direction, day,
    schedule, trip and stop to print it.
    """
    sc = timetable_schedules(t, requests).select(
        "request_id", "timetable_id", "schedule_id", "page_number", "direction_index", "day_rank")
    st = t.stop.select(F.col("id").alias("stop_id"), F.col("name").alias("stop_name"))
    return (sc.join(t.stop_time, "schedule_id").join(st, "stop_id")
            .select("request_id", "timetable_id", "page_number", "direction_index", "day_rank",
                    "schedule_id", "trip_index", "stop_sequence", "stop_name", "cell_type",
                    clock("dep_min").alias("departure_time"), "note_code", "raw_value"))


def search_stops(t: Tables, requests: DataFrame, limit: int = 20) -> DataFrame:
    """Up to ``limit`` stops per text, names starting with it first; all stops for no text.

    Distinct texts are searched once. The match is on names only, each partition keeps its
    own best ``limit`` rows before anything moves, and coordinates are read for what is left.
    """
    asked = requests.select(F.coalesce("q", F.lit("")).alias("q")).distinct()
    st = t.stop.select(F.col("id").alias("stop_id"), "lat", "lon")
    hits = stop_names(t).find(asked).withColumn(
        "is_prefix", F.ilike("name", F.concat(F.col("q"), F.lit("%"))))
    best = top_per(hits, ["q"], [F.desc("is_prefix"), "name", "stop_id"], limit).join(st, "stop_id")
    return (requests.select("request_id", F.coalesce("q", F.lit("")).alias("q")).join(best, "q")
            .select("request_id", "q", F.col("_rank").alias("rank"), "stop_id", "name",
                    "lat", "lon"))


def list_stops(t: Tables, limit: int = 20) -> DataFrame:
    return t.stop.select("id", "name", "lat", "lon").orderBy("name", "id").limit(limit)


def areas(t: Tables) -> DataFrame:
    """Places routes are named after that are not stops themselves."""
    ends = (t.route.select(F.col("origin").alias("area"))
            .union(t.route.select("destination")).filter("area <> ''").distinct())
    return ends.join(t.stop.select(F.col("name").alias("area")), "area", "left_anti")


def departure_board(t: Tables, requests: DataFrame) -> DataFrame:
    """Published departures of a stop on a day type: requests (stop_id, day_type)."""
    timed = t.stop_time.filter("cell_type = 'TIME'").select("schedule_id", "stop_id", "trip_index",
                                                            "dep_min", "raw_value")
    sc = t.schedule.select(F.col("id").alias("schedule_id"), "timetable_id", "direction_label",
                           "day_type")
    tt = t.timetable.select(F.col("id").alias("timetable_id"), "route_id")
    r = t.route.select(F.col("id").alias("route_id"), F.col("name").alias("route_name"))
    # Departures learn their day where they lie, and then meet requests for that day only: no
    # departure is listed under the days it does not run on.
    runs = timed.join(sc.join(tt, "timetable_id").join(r, "route_id"), "schedule_id")
    return (requests.select("request_id", "stop_id", "day_type").join(runs, ["stop_id", "day_type"])
            .select("request_id", "stop_id", "day_type", "schedule_id", "trip_index",
                    "route_name", "direction_label", clock("dep_min").alias("departure_time")))


def printed_grid(t: Tables, requests: DataFrame) -> DataFrame:
    """A timetable's cells for one day type, long form: requests (timetable_id, day_type)."""
    sc = t.schedule.select(F.col("id").alias("schedule_id"), "timetable_id", "day_type")
    st = t.stop.select(F.col("id").alias("stop_id"), F.col("name").alias("stop_name"))
    return (requests.select("request_id", "timetable_id", "day_type")
            .join(sc, ["timetable_id", "day_type"]).join(t.stop_time, "schedule_id")
            .join(st, "stop_id")
            .select("request_id", "timetable_id", "schedule_id", "trip_index", "stop_sequence",
                    "stop_name", "raw_value"))


def grid_text():
    """What a printed cell shows: time with note, via, or blank."""
    return (F.when(F.col("cell_type") == "TIME", F.concat(
        F.coalesce(clock("dep_min"), F.lit("")), F.coalesce("note_code", F.lit(""))))
        .when(F.col("cell_type") == "VIA", "via").otherwise(""))


def grid_columns(t: Tables, width: int) -> DataFrame:
    """Printed grids of all schedules in sheets of ``width`` trips: one row per stop and
    sheet, columns t1..tN. Wider schedules continue on further sheets, as in print.
    """
    cells = t.stop_time.select(
        "schedule_id", "stop_sequence", F.floor(F.col("trip_index") / width).alias("sheet"),
        (F.col("trip_index") % width).alias("slot"), grid_text().alias("cell"))
    return (cells.groupBy("schedule_id", "stop_sequence", "sheet")
            .pivot("slot", list(range(width))).agg(F.first("cell"))
            .select("schedule_id", "stop_sequence", "sheet",
                    *[F.coalesce(F.col(f"`{i}`"), F.lit("")).alias(f"t{i + 1}")
                      for i in range(width)]))


def directions(t: Tables) -> DataFrame:
    """Directions of each timetable with the label of the first schedule shown for it."""
    sc = t.schedule.withColumn("rank", day_rank("day_type", other=4))
    return first_per(sc, ["timetable_id", "direction_index"], ["page_number", "rank", "id"]).select(
        "timetable_id", "direction_index", "direction_label")


def direction_days(t: Tables) -> DataFrame:
    """Known day types of each direction, with their display position."""
    return (t.schedule.filter(F.col("day_type").isin(DAY_ORDER))
            .select("timetable_id", "direction_index", "day_type",
                    day_rank("day_type").alias("day_rank")).distinct())


def current_schedule(t: Tables) -> DataFrame:
    """The schedule shown for a timetable, direction and day type: the first listed."""
    return first_per(t.schedule, ["timetable_id", "direction_index", "day_type"],
                     ["page_number", "id"]).select(
        "timetable_id", "direction_index", "day_type", F.col("id").alias("schedule_id"))


def lookup_places(gazetteer: DataFrame, requests: DataFrame, limit: int = 5) -> DataFrame:
    """Place hits for a text from a gazetteer (q, rank, display_name, lat, lon as text).

    The short name ends at the first comma. A text with any unreadable coordinate gives
    no hits at all.
    """
    rows = gazetteer.select(
        "q", "rank", F.substring_index("display_name", ",", 1).alias("name"),
        F.col("display_name").alias("full_name"),
        F.expr("try_cast(lat AS double)").alias("lat"),
        F.expr("try_cast(lon AS double)").alias("lon"))
    best = top_per(rows, ["q"], ["rank", "full_name"], limit).withColumnRenamed("_rank", "place_no")
    bad = best.filter("lat IS NULL OR lon IS NULL").select("q").distinct()
    return (requests.select("request_id", "q").join(best.join(bad, "q", "left_anti"), "q")
            .select("request_id", "q", "place_no", "name", "full_name", "lat", "lon"))


def suggestions(t: Tables, gazetteer: DataFrame, requests: DataFrame, max_areas: int = 3,
                max_stops: int = 6, max_places: int = 3) -> DataFrame:
    """Merged suggestions for a text: areas, then stops with coordinates, then places.

    ``group_no`` and ``pos`` give the order; stops carry their id and coordinates, places
    their full text and coordinates. Of the first ``max_stops`` stops found those without
    coordinates are left out.
    """
    asked = requests.select("request_id", F.trim("q").alias("q"))
    once = asked.select(F.col("q").alias("request_id"), "q").distinct()
    no_id, no_text, no_place = (F.lit(None).cast(k) for k in ("bigint", "string", "double"))

    def group(rows, no, kind, pos, name, stop_id=no_id, lat=no_place, lon=no_place, text=no_text):
        return rows.select("q", F.lit(kind).alias("kind"), F.lit(no).alias("group_no"),
                           F.col(pos).alias("pos"), F.col(name).alias("name"),
                           stop_id.alias("stop_id"), lat.alias("lat"), lon.alias("lon"),
                           text.alias("full_name"))

    at = {"lat": F.col("lat"), "lon": F.col("lon")}
    area = group(top_per(area_names(t).find(asked), ["q"], ["area"], max_areas),
                 1, "area", "_rank", "area")
    stop = group(search_stops(t, once, max_stops).filter("lat IS NOT NULL AND lon IS NOT NULL"),
                 2, "stop", "rank", "name", F.col("stop_id"), **at)
    # The lookup's own limit holds first: an unreadable row among those hides all of them.
    found = lookup_places(gazetteer, once).filter(F.col("place_no") <= max_places)
    place = group(found,
                  3, "place", "place_no", "name", text=F.col("full_name"), **at)
    every = area.unionByName(stop).unionByName(place)
    return asked.join(every, "q").select("request_id", *every.columns)


def uncovered_days(options: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, core day) pairs a request has no option for."""
    wanted = requests.select("request_id", F.explode(
        F.array(*[F.lit(d) for d in CORE_DAYS])).alias("day_type"))
    return wanted.join(options.select("request_id", "day_type").distinct(),
                       ["request_id", "day_type"], "left_anti")
