"""Direct journeys between stops and pins.

Every distinct endpoint is turned into spots, the places where a schedule passes it. Pairs
of endpoints meet on schedules; the spots of schedules that both share become anchors, where
a trip can be boarded or left, and trips with a boarding anchor before an alighting anchor
are matched. The matches are written once; options, departures, segments and road paths all
read them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalars import clock, clock_rounded, day_rank
from ..session import stored
from ..sources.tables import Tables
from .blocks import first_per, running, top_per
from .journeys import SERVICE, schedule_service
from .locate import PIN_THRESHOLD_M, locate, stops_near

# How far alternatives are and how many are shown, and the distance under which a pin
# counts as being at the stop itself.
NEARBY_RADIUS_M = 2500.0
NEARBY_SHOWN = 8
SAME_PLACE_M = 30.0
DAY_ALTERNATIVE_RADIUS_M = 8000.0
DAY_ALTERNATIVES_SHOWN = 3


def floor_minutes() -> Column:
    """The published time of a visit, else the latest time before it if that is not past
    the earliest time after it."""
    usable = F.col("prior_min").isNotNull() & (
        F.col("next_min").isNull() | (F.col("prior_min") <= F.col("next_min")))
    return F.coalesce("dep_min", F.when(usable, F.col("prior_min")))


def stop_spots(t: Tables, stops: DataFrame) -> DataFrame:
    """Where schedules list the stops of ``stops`` (key, stop_id): no trips, no cells."""
    here = t.schedule_stop.select("schedule_id", "stop_sequence", "stop_id")
    return (stops.join(here, "stop_id")
            .withColumns({"fraction": F.lit(0.0), "distance_m": F.lit(0.0),
                          "leg_from": F.col("stop_id"), "leg_to": F.lit(None).cast("bigint")})
            .drop("stop_id"))


def stop_cells(t: Tables, spots: DataFrame) -> DataFrame:
    """Anchors of ``stop_spots``: one for each trip that serves the row, at its exact position."""
    minutes = floor_minutes()
    guessed = F.col("dep_min").isNull() & minutes.isNotNull()
    cells = t.visit.select("schedule_id", "trip_index", "stop_sequence", "dep_min", "raw_value",
                           "prior_min", "next_min")
    return (spots.join(cells, ["schedule_id", "stop_sequence"])
            .withColumns({"position": F.col("stop_sequence").cast("double"),
                          "minutes": minutes.cast("double"),
                          "raw": F.when(guessed, F.concat(F.lit("from "), clock("prior_min")))
                          .otherwise(F.col("raw_value")), "approx": guessed})
            .drop("stop_sequence", "fraction", "dep_min", "raw_value", "prior_min", "next_min"))


def stop_anchors(t: Tables, stops: DataFrame) -> DataFrame:
    """Anchors of named stops: one per visit, at its exact position."""
    ids = stops.select("stop_id").distinct().withColumn("place", F.col("stop_id"))
    return stop_cells(t, stop_spots(t, ids)).withColumnRenamed("place", "stop_id")


def pin_spots(t: Tables, legs: DataFrame) -> DataFrame:
    """Where schedules run along the legs near pins (``locate``): no trips, no cells."""
    near = legs.select("request_id", "from_stop_id", "to_stop_id", "fraction", "distance_m")
    return (near.join(t.next_stop, ["from_stop_id", "to_stop_id"])
            .withColumnsRenamed({"from_stop_id": "leg_from", "to_stop_id": "leg_to"}))


def leg_cells(t: Tables, rows: DataFrame) -> DataFrame:
    """Trips that serve both ends of the leg after each (schedule_id, stop_sequence)."""
    a = t.visit.select("schedule_id", "trip_index", "stop_sequence", F.col("dep_min").alias("m_a"))
    b = t.visit.select("schedule_id", "trip_index", (F.col("stop_sequence") - 1).alias("stop_sequence"),
                       F.col("dep_min").alias("m_b"))
    return (rows.select("schedule_id", "stop_sequence").distinct()
            .join(a, ["schedule_id", "stop_sequence"])
            .join(b, ["schedule_id", "trip_index", "stop_sequence"]))


def pin_cells(t: Tables, spots: DataFrame) -> DataFrame:
    """Anchors of ``pin_spots``: a fraction along a leg, time interpolated."""
    f, a, b = F.col("fraction"), F.col("m_a"), F.col("m_b")
    minutes = F.coalesce(a + f * (b - a), a.cast("double"), b.cast("double"))
    return (spots.join(leg_cells(t, spots), ["schedule_id", "stop_sequence"])
            .withColumns({"position": F.col("stop_sequence") + f, "minutes": minutes})
            .withColumns({"raw": F.coalesce(clock_rounded("minutes"), F.lit("via")),
                          "approx": F.lit(True)})
            .drop("stop_sequence", "fraction", "m_a", "m_b"))


def pin_anchors(t: Tables, legs: DataFrame) -> DataFrame:
    """Anchors of pins, from ``locate``."""
    return pin_cells(t, pin_spots(t, legs))


def labelled(t: Tables, df: DataFrame, leg_from: str, leg_to: str, label: str) -> DataFrame:
    """Adds an anchor's label: the stop's name, or ``near A–B`` for a pin on leg A-B."""
    sa = t.stop.select(F.col("id").alias("_a"), F.col("name").alias("_name_a"))
    sb = t.stop.select(F.col("id").alias("_b"), F.col("name").alias("_name_b"))
    return (df.join(sa, F.col(leg_from) == F.col("_a")).join(sb, F.col(leg_to) == F.col("_b"), "left")
            .withColumn(label, F.when(F.col("_b").isNull(), F.col("_name_a")).otherwise(
                F.concat(F.lit("near "), F.col("_name_a"), F.lit("–"), F.col("_name_b"))))
            .drop("_a", "_b", "_name_a", "_name_b"))


def _place(side: str) -> Column:
    """An endpoint's identity, null when it has none: a stop id wins over coordinates."""
    stop, lat, lon = (F.col(f"{side}_{c}") for c in ("stop_id", "lat", "lon"))
    return F.when(stop.isNotNull(), F.concat(F.lit("stop:"), stop.cast("string"))).when(
        lat.isNotNull() & lon.isNotNull(),
        F.concat(F.lit("pin:"), lat.cast("string"), F.lit(":"), lon.cast("string")))


def endpoint_spots(t: Tables, places: DataFrame, threshold: float) -> DataFrame:
    """Where schedules pass distinct endpoints (place, stop_id, lat, lon), stops and pins alike.

    Spots of pins have a ``leg_to``, those of stops have none.
    """
    stops = places.filter("stop_id IS NOT NULL").select("place", "stop_id")
    pins = places.filter("stop_id IS NULL").select(F.col("place").alias("request_id"), "lat", "lon")
    if pins.isEmpty():
        # No paths are read where every endpoint is a stop.
        return stop_spots(t, stops)
    legs = stored(locate(t, pins, threshold), "pin_legs")
    return stop_spots(t, stops).unionByName(
        pin_spots(t, legs).withColumnRenamed("request_id", "place"))


_SCHEDULE = ["place", "schedule_id"]


def shared_schedules(spots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(f_place, t_place, schedule_id): schedules that pass the second endpoint of a pair
    later than the first one somewhere."""
    at = F.col("stop_sequence") + F.col("fraction")
    reach = stored(spots.groupBy(*_SCHEDULE).agg(F.min(at).alias("low"), F.max(at).alias("high")),
                   "reach")
    f = reach.select(F.col("place").alias("f_place"), "schedule_id", "low")
    to = reach.select(F.col("place").alias("t_place"), "schedule_id", "high")
    return (pairs.join(f, "f_place").join(to, ["t_place", "schedule_id"])
            .filter("high > low").select("f_place", "t_place", "schedule_id"))


def spot_anchors(t: Tables, spots: DataFrame, shared: DataFrame) -> DataFrame:
    """Anchors of the spots whose schedule some pair shares: only these read cells."""
    wanted = shared.select(F.col("f_place").alias("place"), "schedule_id").union(
        shared.select("t_place", "schedule_id")).distinct()
    used = spots.join(wanted, _SCHEDULE, "left_semi")
    return stop_cells(t, used.filter("leg_to IS NULL")).unionByName(
        pin_cells(t, used.filter("leg_to IS NOT NULL")))


# Equal positions go to the nearer leg, then to the lower stop ids.
_FIRST = ["position", "distance_m", "leg_from", "leg_to"]
_TRIP = ["schedule_id", "trip_index"]
_ENDS = ["f_place", "t_place"]
_SERVED = [*_ENDS, *SERVICE]


def _side(anchors: DataFrame, place: str, prefix: str) -> DataFrame:
    return anchors.select(F.col("place").alias(place), *_TRIP, *[
        F.col(c).alias(f"{prefix}_{c}") for c in
        ("position", "minutes", "raw", "approx", "distance_m", "leg_from", "leg_to")])


def match_trips(anchors: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per (endpoint pair, trip): the earliest boarding anchor and the first
    alighting anchor after it that is at most a minute early."""
    board = first_per(anchors, ["place", *_TRIP], _FIRST)
    b, a = _side(board, "f_place", "b"), _side(anchors, "t_place", "a")
    later = ((F.col("a_position") > F.col("b_position"))
             & (F.col("a_minutes").isNull() | F.col("b_minutes").isNull()
                | (F.col("a_minutes") >= F.col("b_minutes") - 1)))
    met = (shared.join(b, ["f_place", "schedule_id"]).join(a, ["t_place", *_TRIP]).filter(later))
    return first_per(met, [*_ENDS, *_TRIP], [f"a_{c}" for c in _FIRST])


@dataclass
class Plan:
    """Plan results as flat tables sharing (request_id, service) keys, each worked out when it is
    asked for: only road points read and write paths."""

    t: Tables
    requests: DataFrame
    threshold: float

    @cached_property
    def _valid(self) -> DataFrame:
        named = self.requests.withColumns({"f_place": _place("from"), "t_place": _place("to")})
        return named.filter("f_place IS NOT NULL AND t_place IS NOT NULL")

    @cached_property
    def _matches(self) -> DataFrame:
        return stored(_matched(self.t, self._valid, self.threshold), "matches")

    @property
    def _lead(self) -> DataFrame:
        return first_per(self._matches, _SERVED, _TRIP)

    def _asked(self, df: DataFrame, *cols) -> DataFrame:
        return self._valid.join(df, _ENDS).select("request_id", *SERVICE, *cols)

    @cached_property
    def options(self) -> DataFrame:
        t = self.t
        shown = labelled(t, labelled(t, self._lead, "b_leg_from", "b_leg_to", "b_label"),
                         "a_leg_from", "a_leg_to", "a_label")
        return self._asked(
            shown, "day_label", day_rank("day_type").alias("day_rank"),
            F.col("b_approx").alias("board_approx"), F.col("a_approx").alias("alight_approx"),
            F.col("b_label").alias("board_label"), F.col("a_label").alias("alight_label"))

    @cached_property
    def departures(self) -> DataFrame:
        return self._asked(
            first_per(self._matches, [*_SERVED, "b_raw", "a_raw"], _TRIP),
            F.col("b_raw").alias("board_raw"), F.col("b_approx").alias("board_approx"),
            F.col("b_minutes").alias("board_minutes"), F.col("a_raw").alias("arrive_raw"),
            F.col("a_approx").alias("arrive_approx"), F.col("a_minutes").alias("arrive_minutes"),
            *_TRIP, F.greatest(F.lit(0), F.ceil(F.col("b_position") - 1e-6)).alias("from_seq"),
            F.floor(F.col("a_position") + 1e-6).alias("to_seq"))

    @cached_property
    def segment_stops(self) -> DataFrame:
        return self._asked(_segment(self.t, self._lead, _SERVED),
                           "stop_sequence", "stop_id", "name", "lat", "lon")

    @cached_property
    def road_points(self) -> DataFrame:
        return self._asked(_road_points(self.t, self._lead, _SERVED), "leg_no", "point_no", "lat", "lon")

    @cached_property
    def status(self) -> DataFrame:
        return plan_status(self.t, self.requests)


def _matched(t: Tables, valid: DataFrame, threshold: float) -> DataFrame:
    """Matched trips of every distinct pair of endpoints, with their service."""
    pairs = valid.select(*_ENDS).distinct()

    def end(place, side):
        stop = F.col(f"{side}_stop_id")
        return valid.select(F.col(place).alias("place"), stop.alias("stop_id"), *[
            F.when(stop.isNull(), F.col(f"{side}_{c}")).alias(c) for c in ("lat", "lon")])
    places = stored(end("f_place", "from").union(end("t_place", "to")).distinct(), "places")
    # Endpoints meet on schedules first; cells are read only for schedules that both share.
    spots = stored(endpoint_spots(t, places, threshold), "spots")
    shared = stored(shared_schedules(spots, pairs), "shared")
    anchors = stored(spot_anchors(t, spots, shared), "anchors")
    return match_trips(anchors, shared).join(
        schedule_service(t).drop("timetable_id", "route_id"), "schedule_id")


def plan(t: Tables, requests: DataFrame, threshold: float = PIN_THRESHOLD_M) -> Plan:
    """Direct journeys between endpoints: requests hold from_/to_ (stop_id, lat, lon).

    Within a service the lowest (schedule, trip) supplies segment, path and labels, and
    departures with the same printed pair count once.
    """
    return Plan(t, requests, threshold)


def plan_status(t: Tables, requests: DataFrame) -> DataFrame:
    """Each request's endpoints described, with an error where one is missing."""
    st = t.stop.select("id", "name", "lat", "lon")
    out = requests.select("request_id", *[F.col(f"{s}_{c}") for s in ("from", "to")
                                          for c in ("stop_id", "lat", "lon")])
    for s in ("from", "to"):
        known = st.select(*[F.col(c).alias(f"_{c}") for c in st.columns])
        lat, lon, sid = (F.col(f"{s}_{c}") for c in ("lat", "lon", "stop_id"))
        out = (out.join(known, sid == F.col("_id"), "left")
               .withColumn(f"{s}_kind", F.when(sid.isNotNull(), "stop")
                           .when(lat.isNotNull() & lon.isNotNull(), "pin"))
               .withColumn(f"{s}_name", F.col("_name"))
               .withColumn(f"{s}_lat", F.when(sid.isNotNull(), F.col("_lat")).otherwise(lat))
               .withColumn(f"{s}_lon", F.when(sid.isNotNull(), F.col("_lon")).otherwise(lon))
               .drop("_id", "_name", "_lat", "_lon"))
    bad = F.col("from_kind").isNull() | F.col("to_kind").isNull()
    return out.withColumn("status", F.when(bad, "endpoint missing").otherwise("ok")).select(
        "request_id", "status", *[f"{s}_{c}" for s in ("from", "to")
                                  for c in ("kind", "stop_id", "name", "lat", "lon")])


def _segment(t: Tables, lead: DataFrame, key: list[str]) -> DataFrame:
    """Stops from the one at or before boarding to the one after alighting."""
    st = t.stop.select(F.col("id").alias("stop_id"), "name", "lat", "lon")
    return (lead.select(*key, "schedule_id", "b_position", "a_position")
            .join(t.schedule_stop, "schedule_id")
            .filter(F.col("stop_sequence").between(F.floor("b_position"), F.floor("a_position") + 1))
            .join(st, "stop_id"))


def _road_points(t: Tables, lead: DataFrame, key: list[str]) -> DataFrame:
    """Points of the road ridden, leg by leg, without repeating the joints.

    Legs are trimmed to the ridden part. A leg with no stored path runs straight between
    its stops, or is left out where a stop has no coordinates. The joint test looks at
    the previous leg with points, found by a running maximum over leg numbers.
    """
    b, a = F.col("b_position"), F.col("a_position")
    ends = lead.select(
        *key, "schedule_id", F.floor(b).alias("lo"),
        F.when(a > F.floor(a), F.floor(a) + 1).otherwise(F.floor(a)).alias("hi"),
        (b - F.floor(b)).alias("head"), (a - F.floor(a)).alias("tail"))
    st = t.stop.select("id", "lat", "lon")
    legs = t.next_stop.withColumnRenamed("stop_sequence", "leg_no")
    sa = st.select(F.col("id").alias("from_stop_id"), F.struct("lat", "lon").alias("p_a"))
    sb = st.select(F.col("id").alias("to_stop_id"), F.struct("lat", "lon").alias("p_b"))
    g = t.leg_geometry.select("from_stop_id", "to_stop_id", F.col("path").alias("road"))
    straight = F.when(F.col("p_a.lat").isNotNull() & F.col("p_b.lat").isNotNull(),
                      F.array("p_a", "p_b"))
    path = F.when(F.size("road") > 0, F.col("road")).otherwise(straight)
    start = F.when(F.col("leg_no") == F.col("lo"), F.col("head")).otherwise(F.lit(0.0))
    end = F.when((F.col("leg_no") == F.col("hi") - 1) & (F.col("tail") > 0),
                 F.col("tail")).otherwise(F.lit(1.0))
    pieces = (ends.join(legs, "schedule_id").filter("leg_no >= lo AND leg_no < hi")
              .join(sa, "from_stop_id").join(sb, "to_stop_id")
              .join(g, ["from_stop_id", "to_stop_id"], "left")
              .withColumn("piece", geo.slice_path(path, start, end))
              .filter(F.size("piece") > 0).select(*key, "leg_no", "piece"))
    ring = stored(pieces, "road")
    ends_at = ring.select(*key, "leg_no", F.element_at("piece", -1).alias("last"))
    before = _previous(ends_at, key)
    same = F.element_at("piece", 1) == F.col("prev")
    rest = F.when(same, F.slice("piece", F.lit(2), F.size("piece") - 1)).otherwise(F.col("piece"))
    return (ring.join(before, [*key, "leg_no"], "left")
            .select(*key, "leg_no", F.posexplode(rest).alias("point_no", "p"))
            .select(*key, "leg_no", "point_no", F.col("p.lat").alias("lat"),
                    F.col("p.lon").alias("lon")))


def _previous(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, leg_no, prev): the last point of the leg before, skipping missing legs."""
    with_last = rows.withColumn("_v", F.struct("leg_no", "last"))
    return running(with_last, key, "leg_no", {"_p": ("max", "_v", "before", False)}).select(
        *key, "leg_no", F.col("_p.last").alias("prev"))


def reachable_from_pins(t: Tables, pins: DataFrame, threshold: float = PIN_THRESHOLD_M) -> DataFrame:
    """Stops downstream of each pin on one bus, with the number of trips."""
    legs = stored(locate(t, pins, threshold), "pin_legs")
    spots = stored(pin_spots(t, legs), "pin_spots")
    at = (spots.join(leg_cells(t, spots), ["schedule_id", "stop_sequence"])
          .groupBy("request_id", *_TRIP)
          .agg(F.min(F.col("stop_sequence") + F.col("fraction")).alias("pos")))
    cells = t.visit.select(*_TRIP, "stop_sequence", "stop_id")
    found = (at.join(cells, _TRIP).filter("stop_sequence > pos")
             .groupBy("request_id", "stop_id").agg(F.count(F.lit(1)).alias("trip_count")))
    st = t.stop.select(F.col("id").alias("stop_id"), "name", "lat", "lon")
    return found.join(st, "stop_id").select("request_id", "stop_id", "name", "lat", "lon",
                                            "trip_count")


def downstream_of_trip(t: Tables, requests: DataFrame) -> DataFrame:
    """Stops one trip serves after a position: requests (schedule_id, trip_index, position)."""
    st = t.stop.select(F.col("id").alias("stop_id"), "name", "lat", "lon")
    cells = t.visit.select(*_TRIP, "stop_sequence", "stop_id")
    return (requests.select("request_id", *_TRIP, "position").join(cells, _TRIP)
            .filter(F.col("stop_sequence") > F.col("position")).join(st, "stop_id")
            .select("request_id", "stop_sequence", "stop_id", "name", "lat", "lon"))


def nearby_origins(t: Tables, requests: DataFrame, radius: float = NEARBY_RADIUS_M,
                   limit: int = NEARBY_SHOWN) -> DataFrame:
    """Other stops near a point with a direct bus to a stop.

    Requests hold (lat, lon, to_id, exclude_id or null, day_type or null). All stops within
    the radius that have a bus are looked at and the nearest ``limit`` are returned. Buses are
    worked out from the destinations, once for each and all requests, so stops without one
    never meet a point.
    """
    from .connect import backward
    from .journeys import direct_service
    r = requests.select("request_id", "lat", "lon", "to_id", "exclude_id", "day_type")
    asks = backward(t, r).join(r.select("to_id", "day_type").distinct(), "to_id")
    served = stored(direct_service(t, asks.select(
        F.struct("x", "to_id", "day_type").alias("request_id"),
        F.col("x").alias("from_id"), "to_id", "day_type")).select(
        F.col("from_id").alias("stop_id"), "to_id", F.col("day_type").alias("d"), "earliest",
        "trip_count"), "served")
    with_bus = stops_near(t, r, radius, served, "to_id").filter(
        F.col("day_type").eqNullSafe(F.col("d"))).filter(
        "stop_id <> to_id AND stop_id <> coalesce(exclude_id, -1) AND "
        f"NOT (exclude_id IS NULL AND metres < {SAME_PLACE_M})")
    best = top_per(with_bus, ["request_id"], ["metres", "stop_id"], limit)
    return best.select("request_id", F.col("_rank").alias("rank"), "stop_id", "name",
                       F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"),
                       F.rint("metres").cast("bigint").alias("distance_m"), "trip_count", "earliest")


def missing_day_alternatives(t: Tables, requests: DataFrame, options: DataFrame,
                             radius: float = DAY_ALTERNATIVE_RADIUS_M,
                             limit: int = DAY_ALTERNATIVES_SHOWN) -> DataFrame:
    """For core days a plan has no option on: the ``limit`` nearest origins within ``radius``.

    Requests hold (lat, lon, to_id, exclude_id); ``options`` are the plan's options.
    """
    from .catalog import uncovered_days
    days = uncovered_days(options, requests)
    asks = (requests.select("request_id", "lat", "lon", "to_id", "exclude_id")
            .join(days, "request_id").filter("lat IS NOT NULL AND lon IS NOT NULL")
            .select(F.struct("request_id", "day_type").alias("request_id"), "lat", "lon", "to_id",
                    "exclude_id", "day_type"))
    found = nearby_origins(t, asks, radius, limit)
    return found.select(
        "request_id.request_id", "request_id.day_type", *found.columns[1:])
