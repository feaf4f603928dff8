"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources.network import load, read
from . import requests as R
from .oracle import hhmm
from .registry import query


@query("""
    SELECT 'route' AS table_name, count(*) AS n FROM route
    UNION ALL SELECT 'timetable', count(*) FROM timetable
    UNION ALL SELECT 'stop', count(*) FROM stop""")
def health_counts(spark, sf):
    return C.health(load(spark, sf))


@query("""
    SELECT c_custkey AS request_id, r.id, r.name, r.origin, r.destination, r.letter_group,
           coalesce(n, 0) AS timetable_count
    FROM customer JOIN route r ON r.name ILIKE '%nation ' || c_nationkey || '%'
                              AND r.letter_group = upper('n')
    LEFT JOIN (SELECT route_id, count(*) AS n FROM timetable GROUP BY route_id) t
      ON t.route_id = r.id""")
def route_search(spark, sf):
    req = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("q"),
        F.lit("n").alias("letter"))
    return C.search_routes(load(spark, sf), req)


@query("""
    SELECT request_id, CASE WHEN r.id IS NULL THEN 'route not found' ELSE 'ok' END AS status,
           asked_id AS route_id, r.name AS route_name, r.origin,
           r.destination, r.letter_group, t.id AS timetable_id, t.timetable_number,
           t.is_public_holiday, CAST(t.effective_from AS VARCHAR) AS effective_from,
           CAST(t.effective_to AS VARCHAR) AS effective_to, t.pdf_filename, t.pdf_url,
           t.page_count, t.parse_status
    FROM (SELECT CAST(n_nationkey AS BIGINT) AS request_id, CAST(n_nationkey AS BIGINT) AS asked_id
          FROM nation
          UNION ALL SELECT CAST(-1 - n_nationkey AS BIGINT), CAST(-1 - n_nationkey AS BIGINT)
          FROM nation)
    LEFT JOIN route r ON r.id = asked_id
    LEFT JOIN timetable t ON t.route_id = r.id""")
def route_timetables(spark, sf):
    """Every route, and as many ids that no route has."""
    n = F.col("n_nationkey").cast("bigint")
    req = read(spark, sf, "nation").select(F.explode(F.array(n, -1 - n)).alias("request_id"))
    req = req.withColumn("route_id", F.col("request_id"))
    return C.route_detail(load(spark, sf), req).orderBy(*C.route_detail_order())


@query("""
    SELECT t.id AS request_id, t.id AS timetable_id, t.timetable_number, t.is_public_holiday,
           CAST(t.effective_from AS VARCHAR) AS effective_from,
           CAST(t.effective_to AS VARCHAR) AS effective_to, t.pdf_filename, t.pdf_url,
           t.page_count, r.id AS route_id, r.name AS route_name
    FROM timetable t JOIN route r ON r.id = t.route_id""")
def timetable_header(spark, sf):
    return C.timetable_header(load(spark, sf), R.timetable_requests(spark, sf))


@query("""
    SELECT timetable_id AS request_id, timetable_id, code, description FROM timetable_note""")
def timetable_notes(spark, sf):
    return C.timetable_notes(load(spark, sf), R.timetable_requests(spark, sf))


@query("""
    SELECT timetable_id AS request_id, timetable_id, id AS schedule_id, page_number,
           direction_index, direction_label, day_type,
           CASE day_type WHEN 'WEEKDAY' THEN 0 WHEN 'SATURDAY' THEN 1 WHEN 'SUNDAY' THEN 2
                WHEN 'PUBLIC_HOLIDAY' THEN 3 ELSE 4 END AS day_rank,
           day_label, section_timetable_number, no_service
    FROM schedule""")
def schedule_order(spark, sf):
    return C.timetable_schedules(load(spark, sf), R.timetable_requests(spark, sf))


@query("""
    SELECT sc.timetable_id AS request_id, sc.timetable_id, ss.schedule_id, ss.stop_sequence,
           s.name, s.lat, s.lon
    FROM schedule sc JOIN schedule_stop ss ON ss.schedule_id = sc.id
    JOIN stop s ON s.id = ss.stop_id""")
def timetable_stops(spark, sf):
    return C.timetable_stops(load(spark, sf), R.timetable_requests(spark, sf))


@query("""
    SELECT sc.timetable_id AS request_id, sc.timetable_id, t.schedule_id, t.trip_index
    FROM schedule sc JOIN trip t ON t.schedule_id = sc.id""")
def timetable_trips(spark, sf):
    return C.timetable_trips(load(spark, sf), R.timetable_requests(spark, sf))


@query(f"""
    SELECT sc.timetable_id AS request_id, sc.timetable_id, sc.page_number, sc.direction_index,
           CASE sc.day_type WHEN 'WEEKDAY' THEN 0 WHEN 'SATURDAY' THEN 1 WHEN 'SUNDAY' THEN 2
                WHEN 'PUBLIC_HOLIDAY' THEN 3 ELSE 4 END AS day_rank,
           st.schedule_id, st.trip_index, st.stop_sequence, s.name AS stop_name, st.cell_type,
           {hhmm('st.dep_min')} AS departure_time, st.note_code, st.raw_value
    FROM schedule sc JOIN stop_time st ON st.schedule_id = sc.id
    JOIN stop s ON s.id = st.stop_id""")
def timetable_payload(spark, sf):
    return C.timetable_cells(load(spark, sf), R.timetable_requests(spark, sf))


@query("""
    SELECT request_id, q, n AS rank, stop_id, name, lat, lon
    FROM asked JOIN (
        SELECT a.q, s.id AS stop_id, s.name, s.lat, s.lon,
               CAST(row_number() OVER (PARTITION BY a.q ORDER BY s.name ILIKE a.q || '%' DESC,
                                       s.name, s.id) AS INTEGER) AS n
        FROM (SELECT DISTINCT q FROM asked) a JOIN stop s ON s.name ILIKE '%' || a.q || '%'
        QUALIFY n <= 20) USING (q)""", {"asked": """
    SELECT s_suppkey AS request_id,
           upper(substr(p_name, CAST(1 + s_suppkey % 2 AS INTEGER), 3)) AS q
    FROM supplier JOIN part ON p_partkey = s_suppkey"""})
def stop_search(spark, sf):
    return C.search_stops(load(spark, sf), R.name_requests(spark, sf))


@query("SELECT id, name, lat, lon FROM stop ORDER BY name, id LIMIT 20")
def stop_list(spark, sf):
    return C.list_stops(load(spark, sf))


@query("""
    SELECT area FROM (SELECT origin AS area FROM route UNION SELECT destination FROM route)
    WHERE area <> '' AND area NOT IN (SELECT name FROM stop)""")
def areas(spark, sf):
    return C.areas(load(spark, sf))


_DAY_NO = """CASE sc.day_type WHEN 'WEEKDAY' THEN 0 WHEN 'SATURDAY' THEN 1 WHEN 'SUNDAY' THEN 2
                              WHEN 'PUBLIC_HOLIDAY' THEN 3 ELSE 4 END"""


@query(f"""
    SELECT 5 * st.stop_id + {_DAY_NO} AS request_id, st.stop_id, sc.day_type, st.schedule_id, st.trip_index,
           r.name AS route_name, sc.direction_label, {hhmm('st.dep_min')} AS departure_time
    FROM stop_time st JOIN schedule sc ON sc.id = st.schedule_id
    JOIN timetable t ON t.id = sc.timetable_id JOIN route r ON r.id = t.route_id
    WHERE st.cell_type = 'TIME'""")
def departure_board(spark, sf):
    return C.departure_board(load(spark, sf), R.each_day(R.stop_requests(spark, sf)))


@query(f"""
    SELECT 5 * sc.timetable_id + {_DAY_NO} AS request_id, sc.timetable_id, st.schedule_id, st.trip_index,
           st.stop_sequence, s.name AS stop_name, st.raw_value
    FROM stop_time st JOIN schedule sc ON sc.id = st.schedule_id
    JOIN stop s ON s.id = st.stop_id""")
def printed_grid(spark, sf):
    return C.printed_grid(load(spark, sf), R.each_day(R.timetable_requests(spark, sf)))


def _slot(i):
    return (f"coalesce(max(CASE WHEN trip_index % 4 = {i} THEN txt END), '') AS t{i + 1}")


@query(f"""
    SELECT schedule_id, stop_sequence, trip_index // 4 AS sheet,
           {_slot(0)}, {_slot(1)}, {_slot(2)}, {_slot(3)}
    FROM (SELECT *, CASE cell_type WHEN 'TIME' THEN {hhmm('dep_min')} || coalesce(note_code, '')
                         WHEN 'VIA' THEN 'via' ELSE '' END AS txt FROM stop_time)
    GROUP BY schedule_id, stop_sequence, trip_index // 4""")
def printed_grid_pivot(spark, sf):
    return C.grid_columns(load(spark, sf), width=4)


@query("""
    SELECT timetable_id, direction_index, direction_label FROM schedule
    QUALIFY row_number() OVER (PARTITION BY timetable_id, direction_index ORDER BY page_number,
        CASE day_type WHEN 'WEEKDAY' THEN 0 WHEN 'SATURDAY' THEN 1 WHEN 'SUNDAY' THEN 2
             WHEN 'PUBLIC_HOLIDAY' THEN 3 ELSE 4 END, id) = 1""")
def timetable_directions(spark, sf):
    return C.directions(load(spark, sf))


@query("""
    SELECT DISTINCT timetable_id, direction_index, day_type,
           CASE day_type WHEN 'WEEKDAY' THEN 0 WHEN 'SATURDAY' THEN 1 WHEN 'SUNDAY' THEN 2
                ELSE 3 END AS day_rank
    FROM schedule WHERE day_type <> 'OTHER'""")
def direction_days(spark, sf):
    return C.direction_days(load(spark, sf))


@query("""
    SELECT timetable_id, direction_index, day_type, id AS schedule_id FROM schedule
    QUALIFY row_number() OVER (PARTITION BY timetable_id, direction_index, day_type
                               ORDER BY page_number, id) = 1""")
def current_schedule(spark, sf):
    return C.current_schedule(load(spark, sf))


_PLACES = {"place": """
    SELECT 'nation ' || c_nationkey AS q, c_custkey AS rank,
           c_name || ', ' || c_mktsegment AS full_name, c_name AS name, c_acctbal < -950 AS bad,
           CAST(-34.10 AS DOUBLE) + CAST((c_custkey * 3571) % 1000 AS DOUBLE)
               * CAST(0.0005 AS DOUBLE) AS lat,
           CAST(18.30 AS DOUBLE) + CAST((c_custkey * 2741) % 1000 AS DOUBLE)
               * CAST(0.0007 AS DOUBLE) AS lon,
           CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS place_no
    FROM customer""", "good": """
    SELECT * FROM place WHERE place_no <= 5
      AND q NOT IN (SELECT q FROM place WHERE place_no <= 5 AND bad)"""}


@query("""
    SELECT CAST(n_nationkey AS BIGINT) AS request_id, q, place_no, name, full_name,
           round(lat, 6) AS lat, round(lon, 6) AS lon
    FROM nation JOIN good ON q = 'nation ' || n_nationkey""", _PLACES)
def place_lookup(spark, sf):
    n = F.col("n_nationkey").cast("bigint")
    req = read(spark, sf, "nation").select(
        n.alias("request_id"), F.concat(F.lit("nation "), n.cast("string")).alias("q"))
    return C.lookup_places(R.gazetteer(spark, sf), req).select(
        "request_id", "q", "place_no", "name", "full_name", F.round("lat", 6).alias("lat"),
        F.round("lon", 6).alias("lon"))


@query("""
    SELECT request_id, q, kind, group_no, pos, name, stop_id, lat, lon, full_name FROM asked JOIN (
        SELECT a.q, 'area' AS kind, 1 AS group_no,
               CAST(row_number() OVER (PARTITION BY a.q ORDER BY x.area) AS INTEGER) AS pos,
               x.area AS name, CAST(NULL AS BIGINT) AS stop_id, CAST(NULL AS DOUBLE) AS lat,
               CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS VARCHAR) AS full_name
        FROM (SELECT DISTINCT q FROM asked) a JOIN area x ON x.area ILIKE '%' || a.q || '%'
        QUALIFY pos <= 3
        UNION ALL
        SELECT q, 'stop', 2, n, name, id, lat, lon, NULL FROM (
            SELECT a.q, s.id, s.name, s.lat, s.lon, CAST(row_number() OVER (PARTITION BY a.q
                       ORDER BY s.name ILIKE a.q || '%' DESC, s.name, s.id) AS INTEGER) AS n
            FROM (SELECT DISTINCT q FROM asked) a JOIN stop s ON s.name ILIKE '%' || a.q || '%')
        WHERE n <= 6 AND lat IS NOT NULL
        UNION ALL
        SELECT q, 'place', 3, place_no, name, NULL, lat, lon, full_name FROM good
        WHERE place_no <= 3) USING (q)""", {
    **_PLACES,
    "area": """
        SELECT area FROM (SELECT origin AS area FROM route UNION SELECT destination FROM route)
        WHERE area <> '' AND area NOT IN (SELECT name FROM stop)""",
    "asked": """
        SELECT s_suppkey AS request_id, 'nation ' || s_nationkey AS q FROM supplier
        UNION ALL SELECT 1000000 + s_suppkey, substr(p_name, 1, 3)
        FROM supplier JOIN part ON p_partkey = s_suppkey"""})
def suggestions(spark, sf):
    s = read(spark, sf, "supplier")
    by_nation = s.select(F.col("s_suppkey").alias("request_id"), F.concat(
        F.lit("nation "), F.col("s_nationkey").cast("string")).alias("q"))
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    by_stop = s.join(p, s.s_suppkey == p.p_partkey).select(
        (F.col("s_suppkey") + 1000000).alias("request_id"),
        F.substring("p_name", 1, 3).alias("q"))
    return C.suggestions(load(spark, sf), R.gazetteer(spark, sf), by_nation.unionByName(by_stop))
