"""A bus network read out of the given order and line tables.

Parts are stops, nations are routes, customers are timetables, orders are schedules and
order lines are the stops of a schedule. Narrow tables are plain projections; the tables
that need a shuffle are written once per session and read back, as a loaded database
would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalars import clock
from ..operators.blocks import BLOCK, numbered, running
from ..session import buckets_for, stored, stored_in_buckets
from .tables import Tables

# Order priority digit to day type and printed day label.
DAYS = {1: ("WEEKDAY", "MONDAYS TO FRIDAYS"), 2: ("SATURDAY", "SATURDAYS"),
        3: ("SUNDAY", "SUNDAYS"), 4: ("PUBLIC_HOLIDAY", "PUBLIC HOLIDAYS"),
        5: ("OTHER", "SPECIAL RUNS")}

_LOADED: dict[tuple[str, str], Tables] = {}


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The network of one data folder, shared by all queries of the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        _LOADED[key] = derive(spark, sf_dir)
    return _LOADED[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Stops and pins of a tile of the service area. The area grows by a tile for each of these
# numbers of ids, so places stay as dense as they are however many there are.
TILE_STOPS, TILE_PINS = 4000, 200
TILES_NORTH = 100


def tile(key, ids: int):
    """(degrees north, degrees east) from the first tile to the one of an id."""
    n = F.floor(key / F.lit(ids))
    return ((n % TILES_NORTH).cast("double") * F.lit(0.6),
            F.floor(n / TILES_NORTH).cast("double") * F.lit(0.8))


def grid_point(key: str, a: int, b: int, ids: int | None = None):
    """Latitude and longitude spread over the service area by two multipliers, over tiles of
    ``ids`` ids if given."""
    k = F.col(key)
    lat, lon = (F.lit(-34.10) + ((k * a) % 1000).cast("double") * F.lit(0.0005),
                F.lit(18.30) + ((k * b) % 1000).cast("double") * F.lit(0.0007))
    if ids is None:
        return lat, lon
    north, east = tile(k, ids)
    return lat + north, lon + east


def six_digits(c):
    return F.lpad(c.cast("string"), 6, "0")


def _stop(src):
    lat, lon = grid_point("p_partkey", 7919, 104729, TILE_STOPS)
    known = (F.col("p_partkey") % 17) != 0
    return src("part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.when(known, lat).alias("lat"), F.when(known, lon).alias("lon"),
        F.when(known, F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("geocoded_at"),
        F.when(known, F.lit("google")).alias("geocode_source"))


def _route(src):
    n, r = src("nation"), src("region")
    origin = F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").cast("bigint").alias("id"),
                    F.concat(origin, F.lit("-"), F.col("r_name")).alias("name"),
                    origin.alias("origin"), F.col("r_name").alias("destination"),
                    F.substring("n_name", 1, 1).alias("letter_group")))


def _timetable(src):
    c = F.col("c_custkey")
    return src("customer").select(
        c.alias("id"), F.col("c_nationkey").cast("bigint").alias("route_id"),
        six_digits(c % 400).alias("timetable_number"),
        ((c % 10) == 0).alias("is_public_holiday"),
        F.date_add(F.lit("2026-01-01").cast("date"), (c % 28).cast("int")).alias("effective_from"),
        F.when((c % 3) != 0, F.lit("2026-12-31").cast("date")).alias("effective_to"),
        F.concat(F.lit("Pdf/T"), c.cast("string"), F.lit(".pdf")).alias("pdf_url"),
        F.concat(F.lit("T"), c.cast("string"), F.lit(".pdf")).alias("pdf_filename"),
        F.sha2(c.cast("string"), 256).alias("pdf_sha256"),
        F.lit(2).alias("page_count"),
        F.when(F.col("c_acctbal") < -900, "failed").otherwise("parsed").alias("parse_status"),
        F.when(F.col("c_acctbal") < -900, "unreadable page").alias("parse_error"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("scraped_at"),
        F.when(F.col("c_acctbal") >= -900,
               F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("parsed_at"))


def _timetable_note(src):
    c = F.col("c_custkey")
    return src("customer").select(
        c.alias("timetable_id"), F.lit("a").alias("code"),
        F.when(c % 3 == 0, "Mondays").when(c % 3 == 1, "Fridays")
        .otherwise("School days").alias("description"))


def _schedule(src, stops: DataFrame):
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    day, label = F.lit(None), F.lit(None)
    for k, (d, t) in DAYS.items():
        day = F.when(digit == k, d).otherwise(day)
        label = F.when(digit == k, t).otherwise(label)
    served = stops.filter("stop_sequence = 0").select(F.col("schedule_id").alias("sid"))
    o = src("orders")
    return (o.join(served, o.o_orderkey == served.sid, "left")
            .select(i.alias("id"), c.alias("timetable_id"), (1 + i % 2).alias("page_number"),
                    (i % 2).alias("direction_index"),
                    F.concat(F.lit("LINE "), (c % 400).cast("string"), F.lit(" - "),
                             (i % 2).cast("string")).alias("direction_label"),
                    day.alias("day_type"), label.alias("day_label"),
                    six_digits(c % 400).alias("section_timetable_number"),
                    F.date_add(F.lit("2026-01-01").cast("date"), (c % 28).cast("int"))
                    .alias("section_effective_date"),
                    F.col("sid").isNull().alias("no_service")))


def _schedule_stop(src, about: int):
    """One row per (order, part), numbered by first line then part.

    Line numbers are an order's own key, so a block of numbers holds a block of lines.
    """
    # Moved once, by order: what follows is grouped within orders and stays there.
    lines = (src("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
             .repartition(buckets_for(src("lineitem").sparkSession, about), "l_orderkey").groupBy("l_orderkey", "l_partkey")
             .agg(F.min("l_linenumber").alias("first_line")))
    block = F.floor(F.col("first_line") / BLOCK)
    return (numbered(lines, ["l_orderkey"], ["first_line", "l_partkey"], block, "seq")
            .select(F.col("l_orderkey").alias("schedule_id"),
                    F.col("seq").cast("bigint").alias("stop_sequence"),
                    F.col("l_partkey").alias("stop_id")))


def _trip(src):
    i = F.col("o_orderkey")
    return src("orders").select(
        i.alias("schedule_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), i % 4)).alias("trip_index"))


def cell_columns(schedule, seq, trip):
    """(cell_type, minute, note) of a cell, by arithmetic on its key."""
    z = (schedule * 3 + seq * 7 + trip * 5) % 10
    kind = F.when(z < 2, "NONE").when(z < 5, "VIA").otherwise("TIME")
    m = F.when(schedule % 21 == 0, 900 - seq * 15).otherwise(
        300 + (schedule * 37) % 600 + trip * 45 + seq * (5 + schedule % 11))
    return kind, F.pmod(m, F.lit(1440)).cast("int"), F.when(z == 9, "a")


def _stop_time(stops: DataFrame):
    cells = stops.withColumn("trip_index", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("schedule_id") % 4)))
    kind, minute, note = cell_columns(F.col("schedule_id"), F.col("stop_sequence"),
                                      F.col("trip_index"))
    timed = kind == "TIME"
    return cells.select(
        "schedule_id", "trip_index", "stop_sequence", "stop_id", kind.alias("cell_type"),
        F.when(timed, minute).alias("dep_min"), note.alias("note_code"),
        F.when(timed, F.concat(clock(minute), F.coalesce(note, F.lit(""))))
        .when(kind == "VIA", "via").otherwise("--").alias("raw_value"))


def visits(stop_time: DataFrame) -> DataFrame:
    """Served cells with their neighbouring published times.

    The latest time printed before and the earliest printed after, not the nearest: the
    two differ on trips whose rows are printed backwards.
    """
    served = stop_time.filter(F.col("cell_type") != "NONE")
    return running(served, ["schedule_id", "trip_index"], "stop_sequence", {
        "prior_min": ("max", "dep_min", "before", False),
        "next_min": ("min", "dep_min", "after", False),
    }).select("schedule_id", "trip_index", "stop_sequence", "stop_id", "cell_type", "dep_min",
              "note_code", "raw_value", "prior_min", "next_min")


def _leg_geometry(legs: DataFrame):
    """A bent path per leg; about a quarter of the legs have none.

    A path stays in the tile of the stop it starts from: to a stop of another tile it goes to
    the same place of its own tile, so paths don't get longer as the area grows.
    """
    for c, a, b in zip(("lat", "lon"), *(tile(F.col(f"{s}_stop_id"), TILE_STOPS) for s in ("to", "from"))):
        legs = legs.withColumn(f"to_{c}", F.col(f"to_{c}") - a + b)
    mid = F.struct(((F.col("from_lat") + F.col("to_lat")) / 2 + 0.002).alias("lat"),
                   ((F.col("from_lon") + F.col("to_lon")) / 2 - 0.001).alias("lon"))
    path = F.array(F.struct(F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")), mid,
                   F.struct(F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")))
    return (legs.filter((F.col("from_stop_id") + F.col("to_stop_id")) % 4 != 0)
            .select("from_stop_id", "to_stop_id", path.alias("path"))
            .withColumn("length_m", geo.path_length_m("path"))
            .withColumn("box", geo.bounding_box("path"))
            .select("from_stop_id", "to_stop_id", "path", "length_m", "box.*",
                    F.lit("google:directions").alias("source"),
                    F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at")))


def destination(event, stops):
    """The stop an event asks for: one of a fortieth of all stops, of 50 at least."""
    return (event * 3 + 2) % F.greatest(F.lit(50).cast("bigint"), F.floor(stops / 40))


def _search_analytics(src):
    """Every event is a search; from a pin for some users, else from a stop."""
    e, u = F.col("event_id"), F.col("user_id")
    n = src("part").agg(F.count(F.lit(1))).scalar()
    plan = F.col("event_type").isin("view", "click", "purchase")
    pin = plan & (u % 5 == 0)
    lat, lon = grid_point("user_id", 3571, 2741, TILE_PINS)
    return src("events").select(
        e.alias("id"),
        F.when(plan, "/api/plan").otherwise("/api/journeys").alias("endpoint"),
        F.when(pin, "pin").otherwise("stop").alias("from_kind"),
        F.when(~pin, (u * 7 + 1) % n).alias("from_stop_id"),
        F.when(pin, lat).alias("from_lat"), F.when(pin, lon).alias("from_lon"),
        F.lit("stop").alias("to_kind"), destination(e, n).alias("to_stop_id"),
        F.lit(None).cast("double").alias("to_lat"), F.lit(None).cast("double").alias("to_lon"),
        (F.get_json_object("props", "$.k").cast("int") % 6).alias("option_count"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        F.col("ts").cast("timestamp").alias("searched_at"))


def search_options(searches: DataFrame) -> DataFrame:
    """One row per returned option of the synthetic searches."""
    i = F.explode(F.sequence(F.lit(1), F.col("option_count")))
    rows = searches.filter("option_count > 0").select("id", "from_stop_id", i.alias("i"))
    return rows.select(
        F.col("id").alias("search_id"),
        six_digits((F.coalesce("from_stop_id", F.lit(0)) + F.col("i")) % 400).alias("timetable_number"),
        F.concat(F.lit("LINE "), ((F.coalesce("from_stop_id", F.lit(0)) + F.col("i")) % 400)
                 .cast("string")).alias("route_label"),
        F.lit("WEEKDAY").alias("day_type"), F.col("i").alias("departure_count"))


def derive(spark: SparkSession, sf_dir: str) -> Tables:
    from ..operators.enrich import distinct_legs

    def src(name):
        return read(spark, sf_dir, name)

    def cells():
        # Two or three trips a schedule.
        return t.kept("cells", lambda: 3 * src("lineitem").count())

    t = Tables(spark, {})
    t._builders.update({
        "stop": lambda: _stop(src),
        "route": lambda: _route(src),
        "timetable": lambda: _timetable(src),
        "timetable_note": lambda: _timetable_note(src),
        # Schedules, their cells and visits lie in the same buckets, so none moves to make the next.
        "schedule_stop": lambda: stored_in_buckets(_schedule_stop(src, cells()), "schedule_stop", cells(),
                                                   "schedule_id", "stop_sequence", in_place=True),
        "schedule": lambda: stored(_schedule(src, t.schedule_stop), "schedule"),
        "trip": lambda: _trip(src),
        "stop_time": lambda: stored_in_buckets(_stop_time(t.schedule_stop), "stop_time", cells(),
                                               "schedule_id", "stop_sequence", in_place=True),
        "visit": lambda: stored_in_buckets(visits(t.stop_time), "visit", cells(),
                                           "schedule_id", "stop_sequence", in_place=True),
        "leg_geometry": lambda: stored(_leg_geometry(distinct_legs(t)), "leg_geometry"),
        "search_analytics": lambda: _search_analytics(src),
        "search_analytics_option": lambda: search_options(t.search_analytics),
    })
    return t
