"""Loading, pruning, audits, itineraries and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import duration_text
from ..operators import connect as X
from ..operators import diff as D
from ..operators import itinerary as I
from ..operators import journeys as J
from ..operators import merge as G
from ..session import stored
from ..sources.network import load, read
from ..sources.pages import parse
from . import requests as R
from .ingest import PARSED, parsed
from .journeys import ASKED_RIDES, EVERY_LEG
from .registry import query

AT = "2026-02-01 00:00:00"


def current_manifest(spark, sf):
    """Timetables still published: those of customers with no debt."""
    t = load(spark, sf)
    paid = read(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    r = t.route.select(F.col("id").alias("route_id"), F.col("name").alias("route_name"), "origin",
                       "destination", "letter_group")
    return (t.timetable.join(paid, "id", "left_semi").join(r, "route_id")
            .select("route_name", "origin", "destination", "letter_group", "timetable_number",
                    "is_public_holiday", F.date_format("effective_from", "yyyy-MM-dd").alias("effective_from"),
                    F.date_format("effective_to", "yyyy-MM-dd").alias("effective_to"),
                    F.col("pdf_url").alias("pdf_path"), "pdf_url", "pdf_filename"))


_NEW = {"fresh": "SELECT * FROM timetable WHERE c_acctbal >= 0",
        "old_route": """SELECT id, name, 'OLD' AS origin, destination, letter_group FROM route
                        WHERE destination IN ('AFRICA', 'ASIA')""",
        "named": """SELECT DISTINCT r.name, r.origin, r.destination, r.letter_group
                    FROM fresh f JOIN route r ON r.id = f.route_id"""}


@query("""
    SELECT o.id, o.name, coalesce(n.origin, o.origin) AS origin,
           coalesce(n.destination, o.destination) AS destination,
           coalesce(n.letter_group, o.letter_group) AS letter_group
    FROM old_route o LEFT JOIN named n ON n.name = o.name
    UNION ALL
    SELECT (SELECT max(id) FROM old_route)
           + row_number() OVER (ORDER BY substr(md5(name), 1, 4), name), name, origin, destination,
           letter_group
    FROM named WHERE name NOT IN (SELECT name FROM old_route)""", _NEW)
def upsert_routes(spark, sf):
    """Two regions' routes are known with an old origin; the manifest brings the rest."""
    old = load(spark, sf).route.filter("destination IN ('AFRICA', 'ASIA')").withColumn(
        "origin", F.lit("OLD"))
    return G.upsert_routes(old, current_manifest(spark, sf))


@query("""
    SELECT id, name, lat, lon FROM stop WHERE lat IS NOT NULL
    UNION ALL
    SELECT (SELECT max(id) FROM stop WHERE lat IS NOT NULL)
           + row_number() OVER (ORDER BY substr(md5(name), 1, 4), name), name, NULL, NULL
    FROM (SELECT DISTINCT s.name FROM schedule_stop ss JOIN stop s ON s.id = ss.stop_id
          WHERE s.lat IS NULL)""")
def stop_dimension(spark, sf):
    """Placed stops are known; every other name printed on a schedule is added."""
    t = load(spark, sf)
    names = t.schedule_stop.join(t.stop.select(F.col("id").alias("stop_id"), "name"), "stop_id").select("name")
    return G.add_stops(t.stop.filter("lat IS NOT NULL"), names).select("id", "name", "lat", "lon")


_LOADED = {**_NEW, "merged": """
    SELECT t.id, t.route_id, t.pdf_filename,
           CASE WHEN f.id IS NULL THEN t.timetable_number
                WHEN t.id IN (SELECT timetable_id FROM schedule) THEN t.timetable_number
                ELSE t.timetable_number END AS timetable_number,
           CASE WHEN f.id IS NULL THEN t.parse_status
                WHEN t.id IN (SELECT timetable_id FROM schedule) THEN 'parsed' ELSE 'failed' END AS parse_status,
           CASE WHEN f.id IS NULL THEN t.parse_error
                WHEN t.id IN (SELECT timetable_id FROM schedule) THEN NULL ELSE 'not downloaded' END AS parse_error,
           CASE WHEN f.id IS NULL THEN 2
                WHEN t.id IN (SELECT timetable_id FROM schedule)
                THEN (SELECT count(*) FROM schedule s WHERE s.timetable_id = t.id) END AS page_count
    FROM timetable t LEFT JOIN fresh f ON f.id = t.id"""}


def _fetched(manifest):
    return manifest.select("pdf_filename", F.sha2("pdf_filename", 256).alias("sha256"),
                           F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


@query("""
    SELECT id, route_id, pdf_filename, timetable_number, parse_status, parse_error,
           CAST(page_count AS INTEGER) AS page_count FROM merged""", _LOADED)
def upsert_timetables(spark, sf):
    t, m = load(spark, sf), current_manifest(spark, sf)
    return G.upsert_timetables(t.timetable, t.route, m, _fetched(m), parsed(spark, sf).files,
                               F.lit(AT).cast("timestamp")).select(
        "id", "route_id", "pdf_filename", "timetable_number", "parse_status", "parse_error", "page_count")


_LIVE = """(SELECT DISTINCT schedule_id, trip_index FROM stop_time WHERE cell_type <> 'NONE')"""
_RELOADED = {**_NEW, "again": "SELECT * FROM schedule WHERE timetable_id IN (SELECT id FROM fresh)",
             "still": "SELECT * FROM schedule WHERE timetable_id NOT IN (SELECT id FROM fresh)"}


@query(f"""
    SELECT 'route' AS table_name, count(*) AS n_rows FROM route
    UNION ALL SELECT 'stop', count(*) FROM stop
    UNION ALL SELECT 'timetable', count(*) FROM timetable
    UNION ALL SELECT 'timetable_note', (SELECT count(*) FROM timetable WHERE c_acctbal < 0)
                     + (SELECT count(DISTINCT timetable_id) FROM again)
    UNION ALL SELECT 'schedule', (SELECT count(*) FROM still) + (SELECT 2 * count(*) FROM again)
    UNION ALL SELECT 'schedule_stop', count(*) FROM schedule_stop
    UNION ALL SELECT 'trip', (SELECT count(*) FROM trip JOIN still ON id = schedule_id)
                     + (SELECT count(*) FROM {_LIVE} l JOIN again ON id = l.schedule_id)
    UNION ALL SELECT 'stop_time', (SELECT count(*) FROM stop_time JOIN still ON id = schedule_id)
                     + (SELECT count(*) FROM stop_time x JOIN {_LIVE} l ON l.schedule_id = x.schedule_id
                        AND l.trip_index = x.trip_index JOIN again ON id = x.schedule_id)
    UNION ALL SELECT 'visit', count(*) FROM visit""", _RELOADED)
def reload_counts(spark, sf):
    """The published part of the network loaded over itself: no stop, timetable or served
    cell is doubled. Each page also prints a section with no service, and trips with no
    served cell are not printed."""
    t, m = load(spark, sf), current_manifest(spark, sf)
    p = parsed(spark, sf)
    out = G.load_batch(t, m, _fetched(m), p, F.lit(AT).cast("timestamp"))
    return G.table_counts(out, _TABLES)


_TABLES = ["route", "stop", "timetable", "timetable_note", "schedule", "schedule_stop", "trip",
           "stop_time", "visit"]


@query(f"""
    SELECT 'route' AS table_name, count(DISTINCT route_id) AS n_rows FROM fresh
    UNION ALL SELECT 'stop', count(*) FROM stop
    UNION ALL SELECT 'timetable', count(*) FROM fresh
    UNION ALL SELECT 'timetable_note', count(DISTINCT timetable_id) FROM again
    UNION ALL SELECT 'schedule', 2 * count(*) FROM again
    UNION ALL SELECT 'schedule_stop', count(*) FROM schedule_stop JOIN again ON id = schedule_id
    UNION ALL SELECT 'trip', count(*) FROM {_LIVE} l JOIN again ON id = l.schedule_id
    UNION ALL SELECT 'stop_time', count(*) FROM stop_time x JOIN {_LIVE} l ON l.schedule_id = x.schedule_id
                     AND l.trip_index = x.trip_index JOIN again ON id = x.schedule_id
    UNION ALL SELECT 'visit', count(*) FROM visit JOIN again ON id = schedule_id""", _RELOADED)
def ingest_run(spark, sf):
    """A whole run: the published files are loaded, what they supersede is pruned."""
    m = current_manifest(spark, sf)
    return G.table_counts(G.ingest(load(spark, sf), m, _fetched(m), parsed(spark, sf),
                                   F.lit(AT).cast("timestamp")), _TABLES)


_TRIAL = {**_RELOADED, "fresh": """
    SELECT * FROM timetable WHERE c_acctbal >= 0 ORDER BY pdf_filename LIMIT 25"""}


@query("""
    SELECT t.id, t.pdf_filename, CASE WHEN f.id IS NULL THEN '2026-01-01' ELSE '2026-02-01' END AS scraped_on,
           coalesce(s.n, 0) AS schedules
    FROM timetable t LEFT JOIN fresh f ON f.id = t.id
    LEFT JOIN (SELECT timetable_id, CAST(sum(n) AS BIGINT) AS n FROM (
                   SELECT timetable_id, 2 AS n FROM again UNION ALL SELECT timetable_id, 1 FROM still)
               GROUP BY timetable_id) s ON s.timetable_id = t.id""", _TRIAL)
def ingest_trial(spark, sf):
    """A trial run over the first 25 files: only those are loaded and nothing is pruned."""
    m = current_manifest(spark, sf)
    out = G.ingest(load(spark, sf), m, _fetched(m), parsed(spark, sf), F.lit(AT).cast("timestamp"), limit=25)
    n = out.schedule.groupBy(F.col("timetable_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return out.timetable.join(n, "id", "left").select(
        "id", "pdf_filename", F.date_format("scraped_at", "yyyy-MM-dd").alias("scraped_on"),
        F.coalesce("n", F.lit(0)).alias("schedules"))


@query("""
    SELECT f.pdf_filename, sc.id + 1 AS page_number, l.new_index AS trip_index, st.stop_sequence,
           s.name AS stop_name, st.cell_type, st.dep_min, st.note_code, st.raw_value
    FROM stop_time st JOIN live l ON l.schedule_id = st.schedule_id AND l.trip_index = st.trip_index
    JOIN schedule sc ON sc.id = st.schedule_id JOIN fresh f ON f.id = sc.timetable_id
    JOIN stop s ON s.id = st.stop_id""", {**_NEW, **PARSED})
def reparse_stored_text(spark, sf):
    """The cells of loaded files, parsed again from the text kept in the tables."""
    m = current_manifest(spark, sf)
    out = G.load_batch(load(spark, sf), m, _fetched(m), parsed(spark, sf), F.lit(AT).cast("timestamp"))
    return parse(G.stored_lines(out)).cells.select(
        "pdf_filename", "page_number", "trip_index", "stop_sequence", "stop_name", "cell_type",
        "dep_min", "note_code", "raw_value")


@query("""
    SELECT 'timetable' AS table_name, (SELECT count(*) FROM fresh) AS n_rows
    UNION ALL SELECT 'route', count(DISTINCT route_id) FROM fresh
    UNION ALL SELECT 'stop', count(*) FROM stop
    UNION ALL SELECT 'timetable_note', count(*) FROM fresh
    UNION ALL SELECT 'schedule', count(*) FROM again
    UNION ALL SELECT 'schedule_stop', count(*) FROM schedule_stop JOIN again ON id = schedule_id
    UNION ALL SELECT 'trip', count(*) FROM trip JOIN again ON id = schedule_id
    UNION ALL SELECT 'stop_time', count(*) FROM stop_time JOIN again ON id = schedule_id
    UNION ALL SELECT 'visit', count(*) FROM visit JOIN again ON id = schedule_id""", _RELOADED)
def prune_superseded(spark, sf):
    out = G.prune_superseded(load(spark, sf), current_manifest(spark, sf))
    return G.table_counts(out, _TABLES)


@query("SELECT id, timetable_number, pdf_filename FROM fresh", _NEW)
def current_timetables(spark, sf):
    return G.prune_superseded(load(spark, sf), current_manifest(spark, sf)).timetable.select(
        "id", "timetable_number", "pdf_filename")


@query("""
    SELECT 'route without timetable' AS problem, id FROM route
    WHERE id NOT IN (SELECT route_id FROM timetable WHERE parse_status = 'failed')
    UNION ALL SELECT 'schedule without timetable', id FROM schedule
    WHERE timetable_id NOT IN (SELECT id FROM timetable WHERE parse_status = 'failed')""")
def orphan_rows(spark, sf):
    """What would be left over were only the failed timetables kept."""
    t = load(spark, sf)
    return G.orphans(t.replacing(timetable=t.timetable.filter("parse_status = 'failed'")))


@query("""
    SELECT (SELECT count(*) FROM fresh) AS published,
           (SELECT count(*) FROM fresh WHERE parse_status = 'parsed') AS current,
           (SELECT count(*) FROM timetable WHERE parse_status = 'parsed' AND c_acctbal < 0) AS superseded,
           (SELECT count(*) FROM fresh WHERE parse_status = 'failed') AS missing""", _NEW)
def freshness_audit(spark, sf):
    t = load(spark, sf)
    held = t.replacing(timetable=t.timetable.filter("parse_status = 'parsed'"))
    return G.freshness_audit(held, current_manifest(spark, sf))


@query("SELECT pdf_filename, parse_error FROM timetable WHERE parse_status = 'failed'")
def failed_parses(spark, sf):
    return G.failed_parses(load(spark, sf))


_PART = """CASE WHEN coalesce(dep, arr) IS NULL THEN 'other' WHEN coalesce(dep, arr) < 720 THEN 'morning'
                WHEN coalesce(dep, arr) < 1020 THEN 'afternoon' ELSE 'evening' END"""


@query(f"""
    SELECT from_id, to_id, day_type, {_PART} AS daypart, count(*) AS departures
    FROM ride r JOIN service v ON v.schedule_id = r.schedule_id
    GROUP BY from_id, to_id, day_type, {_PART}""")
def daypart_counts(spark, sf):
    t = load(spark, sf)
    pairs = R.od_requests(spark, sf).select("from_id", "to_id").distinct()
    rides = J.pair_rides(t, pairs).join(J.schedule_service(t).select("schedule_id", "day_type"), "schedule_id")
    return I.daypart_counts(rides, ["from_id", "to_id", "day_type"], "board_dep_min", "arrive_dep_min")


@query("""
    SELECT DISTINCT direction_label, split_part(direction_label, ' - ', 1) AS origin,
           split_part(direction_label, ' - ', 2) AS terminus, '' AS via FROM schedule""")
def bus_signs(spark, sf):
    return I.bus_signs(load(spark, sf))


def _itineraries(spark, sf):
    """Every customer's orders as an itinerary, ride by ride."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    from ..operators.blocks import numbered
    rides = read(spark, sf, "orders").select(
        c.alias("itinerary_id"), o.alias("schedule_id"), (o * 3 % 4).alias("trip_index"),
        (o % 5).alias("from_seq"), (o % 5 + 2).alias("to_seq"),
        F.when(o % 3 == 0, "SUNDAY").otherwise("WEEKDAY").alias("day_type"),
        F.when(o % 11 != 0, 300 + o * 37 % 900).alias("board_minutes"),
        F.when(o % 13 != 0, 330 + o * 41 % 1000).alias("arrive_minutes"))
    return numbered(rides, ["itinerary_id"], ["schedule_id"], F.floor(F.col("schedule_id") / 4096), "position")


_RIDES = {"rides": """
    SELECT o_custkey AS itinerary_id, o_orderkey AS k,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position,
           CASE WHEN o_orderkey % 3 = 0 THEN 'SUNDAY' ELSE 'WEEKDAY' END AS day_type,
           CASE WHEN o_orderkey % 11 <> 0 THEN 300 + 37 * o_orderkey % 900 END AS board_minutes,
           CASE WHEN o_orderkey % 13 <> 0 THEN 330 + 41 * o_orderkey % 1000 END AS arrive_minutes
    FROM orders"""}


@query("""
    SELECT b.itinerary_id, b.position, a.arrive_minutes - b.board_minutes AS minutes_short
    FROM rides b JOIN rides a ON a.itinerary_id = b.itinerary_id AND a.position = b.position - 1
                             AND a.day_type = b.day_type
    WHERE a.arrive_minutes > b.board_minutes AND a.arrive_minutes - b.board_minutes < 720""", _RIDES)
def itinerary_conflicts(spark, sf):
    return I.conflicts(_itineraries(spark, sf))


@query("""
    SELECT schedule_id, trip_index, b AS board_minutes, a AS arrive_minutes,
           (a - b + 1440) % 1440 AS ride_minutes
    FROM (SELECT schedule_id, trip_index, arg_min(m, stop_sequence) AS b, arg_max(m, stop_sequence) AS a
          FROM (SELECT *, CAST(substr(raw_value, 1, 2) AS INTEGER) * 60
                          + CAST(substr(raw_value, 4, 2) AS INTEGER) AS m
                FROM stop_time WHERE cell_type = 'TIME') GROUP BY 1, 2)""")
def ride_durations(spark, sf):
    """Every trip, by its printed times."""
    return I.ride_durations(load(spark, sf).stop_time, ["schedule_id", "trip_index"])


@query("""
    SELECT itinerary_id, position, ride_key FROM (
        SELECT l_suppkey AS itinerary_id, l_orderkey * 10 + l_linenumber AS position,
               (l_orderkey % 50) || ':' || (l_partkey % 4) || ':' || l_linenumber || ':'
               || (l_linenumber + 1) AS ride_key
        FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY itinerary_id, ride_key ORDER BY position) = 1""")
def unrepeated_rides(spark, sf):
    """Every supplier's lines as planned rides, many of them planned twice."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    rides = read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("itinerary_id"), (o * 10 + n).alias("position"),
        (o % 50).alias("schedule_id"), (F.col("l_partkey") % 4).alias("trip_index"),
        n.alias("from_seq"), (n + 1).alias("to_seq"))
    return I.without_repeats(rides).select("itinerary_id", "position", "ride_key")


@query("""
    SELECT o.request_id || '-' || e.connection_no AS itinerary_id, e.leg_no - 1 AS position,
           e.schedule_id || ':' || e.trip_index || ':' || e.from_seq || ':' || e.to_seq AS ride_key,
           e.from_stop_id, a.name AS from_name, coalesce(a.lat, 0) AS from_lat,
           coalesce(a.lon, 0) AS from_lon, e.to_stop_id, b.name AS to_name,
           coalesce(b.lat, 0) AS to_lat, coalesce(b.lon, 0) AS to_lon, e.route_label,
           e.timetable_number, e.day_type,
           CASE e.day_type WHEN 'WEEKDAY' THEN 'Mon-Fri' WHEN 'SATURDAY' THEN 'Saturday'
                WHEN 'SUNDAY' THEN 'Sunday' WHEN 'PUBLIC_HOLIDAY' THEN 'Public Holiday'
                ELSE 'Other' END AS day_label,
           e.board_raw, e.arrive_raw, e.board_minutes, e.arrive_minutes, e.schedule_id, e.trip_index,
           e.from_seq, e.to_seq
    FROM od o JOIN every e ON e.from_id = o.from_id AND e.to_id = o.to_id
    JOIN stop a ON a.id = e.from_stop_id JOIN stop b ON b.id = e.to_stop_id""", EVERY_LEG)
def planned_connections(spark, sf):
    return I.planned_legs(X.connections(load(spark, sf), R.od_requests(spark, sf)).legs)


@query("""
    SELECT from_id, to_id, CAST(n AS INTEGER) AS n, total_minutes,
           CASE WHEN total_minutes IS NULL THEN 'time not published'
                WHEN total_minutes < 60 THEN total_minutes || ' min'
                WHEN total_minutes % 60 = 0 THEN (total_minutes // 60) || ' h'
                ELSE (total_minutes // 60) || ' h ' || (total_minutes % 60) END AS duration
    FROM two""")
def connection_durations(spark, sf):
    pairs = R.od_requests(spark, sf).select("from_id", "to_id").distinct()
    return X.two_bus(load(spark, sf), pairs, 10, 6).select(
        "from_id", "to_id", F.col("_rank").alias("n"), "total_minutes",
        duration_text("total_minutes").alias("duration"))


def _strips(spark, sf):
    """Every trip of every schedule, ridden from its second stop to its fourth; every third
    ride ends at a pin, every other starts at one."""
    o = F.col("request_id")
    zero = F.lit(0).cast("bigint")
    return R.ride_requests(spark, sf).select(
        "request_id", "schedule_id", "trip_index", zero.alias("from_seq"),
        F.lit(1 << 40).alias("to_seq"), (zero + 1).alias("ride_from"), (zero + 3).alias("ride_to"),
        F.when(o % 2 == 0, "HOME").alias("board_pin"), F.when(o % 3 == 0, "WORK").alias("alight_pin"),
        F.lit("from 06:00").alias("board_time"), F.lit("07:00").alias("alight_time"))


_STRIP = {**ASKED_RIDES, "ordered": """
    SELECT request_id, v.stop_sequence AS seq, s.name, v.cell_type, v.raw_value,
           coalesce(first_value(dep_min IGNORE NULLS) OVER (PARTITION BY request_id ORDER BY stop_sequence
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                    last_value(dep_min IGNORE NULLS) OVER (PARTITION BY request_id ORDER BY stop_sequence
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k
    FROM asked a JOIN visit v ON v.schedule_id = a.schedule_id AND v.trip_index = a.trip_index
    JOIN stop s ON s.id = v.stop_id""",
    "placed": """
    SELECT *, row_number() OVER w - 1 AS n, lead(seq) OVER w AS next_seq,
           request_id % 2 = 0 AS on_pin, request_id % 3 = 0 AS off_pin
    FROM ordered WINDOW w AS (PARTITION BY request_id ORDER BY k NULLS LAST, seq)""",
    "strip": """
    SELECT request_id, n * 3 + 1 AS place, name,
           CASE WHEN cell_type = 'TIME' THEN raw_value WHEN NOT on_pin AND seq = 1 THEN 'from 06:00'
                WHEN NOT off_pin AND seq = 3 THEN '07:00' ELSE 'via' END AS time, false AS approx,
           CASE WHEN NOT on_pin AND seq = 1 THEN 'board' WHEN NOT off_pin AND seq = 3 THEN 'alight'
                ELSE 'mid' END AS role FROM placed
    UNION ALL SELECT request_id, min(n) * 3, 'HOME', 'from 06:00', true, 'board' FROM placed
    WHERE on_pin AND seq >= 1 GROUP BY request_id
    UNION ALL SELECT request_id, n * 3 + 2, 'WORK', '07:00', true, 'alight' FROM placed
    WHERE off_pin AND seq <= 3 AND (next_seq IS NULL OR next_seq > 3)""",
    "span": """
    SELECT request_id, min(CASE WHEN role = 'board' THEN place END) AS first_on,
           max(CASE WHEN role = 'alight' THEN place END) AS last_off FROM strip GROUP BY request_id"""}


@query("""
    SELECT s.request_id, place, name, time, approx, role, coalesce(place < first_on, false) AS before,
           coalesce(place > last_off, false) AS after
    FROM strip s JOIN span e ON e.request_id = s.request_id""", _STRIP)
def trip_strips(spark, sf):
    return I.trip_strip(load(spark, sf), _strips(spark, sf)).orderBy("request_id", "place")


@query("""
    SELECT o.s AS request_id, o.e AS stop_id, CASE WHEN g.n IS NULL THEN '*' ELSE 'trip_count' END AS column_name,
           CAST(CASE WHEN g.n IS NULL THEN NULL ELSE g.n END AS VARCHAR) AS left_value,
           CAST(CASE WHEN g.n IS NULL THEN 1 ELSE o.n END AS VARCHAR) AS right_value
    FROM (SELECT s, e, count(*) AS n FROM hop WHERE s <> e GROUP BY s, e) o
    LEFT JOIN (SELECT s, e, count(*) AS n FROM hop WHERE s <> e
                 AND (dep IS NULL OR arr IS NULL OR arr >= dep) GROUP BY s, e) g
      ON g.s = o.s AND g.e = o.e
    WHERE g.n IS NULL OR g.n <> o.n""")
def result_diff(spark, sf):
    """What the time check changes in the number of trips between stops."""
    t, req = load(spark, sf), R.stop_requests(spark, sf)
    cols = ["request_id", "stop_id", "trip_count"]
    a, b = (stored(df.select(*cols), "compared") for df in (J.reachable(t, req), J.reachable_untimed(t, req)))
    return D.result_diff(a, b, ["request_id", "stop_id"])


@query("""
    SELECT 4 * t.schedule_id + t.trip_index AS pair_id, coalesce(same, false) AS same
    FROM trip t LEFT JOIN (
        SELECT schedule_id, i, bool_and(coalesce(x = y AND cx = 1 AND cy = 1, false)) AS same FROM (
            SELECT v.schedule_id, w.trip_index AS i, stop_sequence,
                   max(CASE WHEN v.trip_index = 0 THEN raw_value END) AS x,
                   max(CASE WHEN v.trip_index = w.trip_index THEN raw_value END) AS y,
                   count(CASE WHEN v.trip_index = 0 THEN 1 END) AS cx,
                   count(CASE WHEN v.trip_index = w.trip_index THEN 1 END) AS cy
            FROM trip w JOIN visit v ON v.schedule_id = w.schedule_id
                                    AND v.trip_index IN (0, w.trip_index)
            GROUP BY v.schedule_id, w.trip_index, stop_sequence) GROUP BY schedule_id, i) u
      ON u.schedule_id = t.schedule_id AND u.i = t.trip_index""")
def equal_rides(spark, sf):
    """Whether each trip of a schedule looks like the first one."""
    o, zero = F.col("schedule_id"), F.lit(0).cast("bigint")
    end = F.lit(1 << 40)
    pairs = R.ride_requests(spark, sf).select(
        F.col("request_id").alias("pair_id"), o.alias("a_schedule_id"), zero.alias("a_trip_index"),
        zero.alias("a_from_seq"), end.alias("a_to_seq"), o.alias("b_schedule_id"),
        F.col("trip_index").alias("b_trip_index"), zero.alias("b_from_seq"), end.alias("b_to_seq"))
    return D.equal_breakdowns(load(spark, sf), pairs)
