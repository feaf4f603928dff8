"""The derived network as SQL, for checking queries in one statement.

``sql(body, *tables)`` puts the named tables, and whatever they read, in front of
``body`` as common table expressions.
"""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "stop": """
        SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name,
               CASE WHEN p_partkey % 17 <> 0 THEN CAST(-34.10 AS DOUBLE)
                    + CAST((p_partkey * 7919) % 1000 AS DOUBLE) * CAST(0.0005 AS DOUBLE)
                    + CAST((p_partkey // 4000) % 100 AS DOUBLE) * CAST(0.6 AS DOUBLE) END AS lat,
               CASE WHEN p_partkey % 17 <> 0 THEN CAST(18.30 AS DOUBLE)
                    + CAST((p_partkey * 104729) % 1000 AS DOUBLE) * CAST(0.0007 AS DOUBLE)
                    + CAST(p_partkey // 4000 // 100 AS DOUBLE) * CAST(0.8 AS DOUBLE) END AS lon
        FROM part""",
    "route": """
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               replace(n_name, '_', ' ') || '-' || r_name AS name,
               replace(n_name, '_', ' ') AS origin, r_name AS destination,
               substr(n_name, 1, 1) AS letter_group
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "timetable": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS route_id,
               lpad(CAST(c_custkey % 400 AS VARCHAR), 6, '0') AS timetable_number,
               c_custkey % 10 = 0 AS is_public_holiday,
               CAST(DATE '2026-01-01' + CAST(c_custkey % 28 AS INTEGER) AS DATE) AS effective_from,
               CASE WHEN c_custkey % 3 <> 0 THEN DATE '2026-12-31' END AS effective_to,
               'Pdf/T' || c_custkey || '.pdf' AS pdf_url, 'T' || c_custkey || '.pdf' AS pdf_filename,
               2 AS page_count,
               CASE WHEN c_acctbal < -900 THEN 'failed' ELSE 'parsed' END AS parse_status,
               CASE WHEN c_acctbal < -900 THEN 'unreadable page' END AS parse_error,
               c_acctbal
        FROM customer""",
    "timetable_note": """
        SELECT c_custkey AS timetable_id, 'a' AS code,
               CASE c_custkey % 3 WHEN 0 THEN 'Mondays' WHEN 1 THEN 'Fridays'
                    ELSE 'School days' END AS description
        FROM customer""",
    "schedule_stop": """
        SELECT l_orderkey AS schedule_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_partkey) - 1
                   AS stop_sequence,
               l_partkey AS stop_id
        FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line
              FROM lineitem GROUP BY l_orderkey, l_partkey)""",
    "schedule": """
        SELECT o_orderkey AS id, o_custkey AS timetable_id, 1 + o_orderkey % 2 AS page_number,
               o_orderkey % 2 AS direction_index,
               'LINE ' || (o_custkey % 400) || ' - ' || (o_orderkey % 2) AS direction_label,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'WEEKDAY' WHEN '2' THEN 'SATURDAY'
                    WHEN '3' THEN 'SUNDAY' WHEN '4' THEN 'PUBLIC_HOLIDAY' ELSE 'OTHER' END AS day_type,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MONDAYS TO FRIDAYS'
                    WHEN '2' THEN 'SATURDAYS' WHEN '3' THEN 'SUNDAYS'
                    WHEN '4' THEN 'PUBLIC HOLIDAYS' ELSE 'SPECIAL RUNS' END AS day_label,
               lpad(CAST(o_custkey % 400 AS VARCHAR), 6, '0') AS section_timetable_number,
               CAST(DATE '2026-01-01' + CAST(o_custkey % 28 AS INTEGER) AS DATE)
                   AS section_effective_date,
               o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS no_service
        FROM orders""",
    "trip": """
        SELECT o_orderkey AS schedule_id, unnest(range(0, o_orderkey % 4 + 1)) AS trip_index
        FROM orders""",
    "cell": """
        SELECT schedule_id, unnest(range(0, schedule_id % 4 + 1)) AS trip_index, stop_sequence,
               stop_id
        FROM schedule_stop""",
    "timed": """
        SELECT *, (3 * schedule_id + 7 * stop_sequence + 5 * trip_index) % 10 AS z,
               ((CASE WHEN schedule_id % 21 = 0 THEN 900 - 15 * stop_sequence
                 ELSE 300 + (37 * schedule_id) % 600 + 45 * trip_index
                      + stop_sequence * (5 + schedule_id % 11) END) % 1440 + 1440) % 1440 AS m
        FROM cell""",
    "stop_time": """
        SELECT schedule_id, trip_index, stop_sequence, stop_id,
               CASE WHEN z < 2 THEN 'NONE' WHEN z < 5 THEN 'VIA' ELSE 'TIME' END AS cell_type,
               CASE WHEN z >= 5 THEN CAST(m AS INTEGER) END AS dep_min,
               CASE WHEN z = 9 THEN 'a' END AS note_code,
               CASE WHEN z < 2 THEN '--' WHEN z < 5 THEN 'via'
                    ELSE lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':'
                         || lpad(CAST(m % 60 AS VARCHAR), 2, '0')
                         || CASE WHEN z = 9 THEN 'a' ELSE '' END END AS raw_value
        FROM timed""",
    "visit": """
        SELECT schedule_id, trip_index, stop_sequence, stop_id, cell_type, dep_min, note_code,
               raw_value,
               max(dep_min) OVER (PARTITION BY schedule_id, trip_index ORDER BY stop_sequence
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_min,
               min(dep_min) OVER (PARTITION BY schedule_id, trip_index ORDER BY stop_sequence
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_min
        FROM stop_time WHERE cell_type <> 'NONE'""",
    "service": """
        SELECT sc.id AS schedule_id, sc.timetable_id, sc.direction_label, sc.day_type,
               sc.day_label, tt.timetable_number, tt.route_id
        FROM schedule sc JOIN timetable tt ON tt.id = sc.timetable_id""",
    "leg": """
        SELECT DISTINCT a.stop_id AS from_stop_id, b.stop_id AS to_stop_id, sa.lat AS from_lat,
               sa.lon AS from_lon, sb.lat AS to_lat, sb.lon AS to_lon
        FROM schedule_stop a
        JOIN schedule_stop b ON b.schedule_id = a.schedule_id
                            AND b.stop_sequence = a.stop_sequence + 1
        JOIN stop sa ON sa.id = a.stop_id JOIN stop sb ON sb.id = b.stop_id
        WHERE sa.lat IS NOT NULL AND sb.lat IS NOT NULL AND a.stop_id <> b.stop_id""",
    # Paths stay in the tile of their first stop.
    "path_end": """
        SELECT * REPLACE (
               to_lat - CAST((to_stop_id // 4000) % 100 AS DOUBLE) * CAST(0.6 AS DOUBLE)
                   + CAST((from_stop_id // 4000) % 100 AS DOUBLE) * CAST(0.6 AS DOUBLE) AS to_lat,
               to_lon - CAST(to_stop_id // 4000 // 100 AS DOUBLE) * CAST(0.8 AS DOUBLE)
                   + CAST(from_stop_id // 4000 // 100 AS DOUBLE) * CAST(0.8 AS DOUBLE) AS to_lon)
        FROM leg""",
    "bent": """
        SELECT *, (from_lat + to_lat) / 2 + CAST(0.002 AS DOUBLE) AS mid_lat,
               (from_lon + to_lon) / 2 - CAST(0.001 AS DOUBLE) AS mid_lon
        FROM path_end WHERE (from_stop_id + to_stop_id) % 4 <> 0""",
    "leg_geometry": """
        SELECT *, 12742000.0 * asin(sqrt(pow(sin(radians(mid_lat - from_lat) / 2), 2)
                   + cos(radians(from_lat)) * cos(radians(mid_lat))
                   * pow(sin(radians(mid_lon - from_lon) / 2), 2))) AS m1,
               12742000.0 * asin(sqrt(pow(sin(radians(to_lat - mid_lat) / 2), 2)
                   + cos(radians(mid_lat)) * cos(radians(to_lat))
                   * pow(sin(radians(to_lon - mid_lon) / 2), 2))) AS m2,
               least(from_lat, mid_lat, to_lat) AS min_lat, least(from_lon, mid_lon, to_lon) AS min_lon,
               greatest(from_lat, mid_lat, to_lat) AS max_lat,
               greatest(from_lon, mid_lon, to_lon) AS max_lon
        FROM bent""",
    "search_analytics": """
        SELECT event_id AS id,
               CASE WHEN event_type IN ('view', 'click', 'purchase') THEN '/api/plan'
                    ELSE '/api/journeys' END AS endpoint,
               CASE WHEN event_type IN ('view', 'click', 'purchase') AND user_id % 5 = 0
                    THEN 'pin' ELSE 'stop' END AS from_kind,
               CASE WHEN NOT (event_type IN ('view', 'click', 'purchase') AND user_id % 5 = 0)
                    THEN (7 * user_id + 1) % (SELECT count(*) FROM part) END AS from_stop_id,
               CASE WHEN event_type IN ('view', 'click', 'purchase') AND user_id % 5 = 0
                    THEN CAST(-34.10 AS DOUBLE)
                    + CAST((user_id * 3571) % 1000 AS DOUBLE) * CAST(0.0005 AS DOUBLE)
                    + CAST((user_id // 200) % 100 AS DOUBLE) * CAST(0.6 AS DOUBLE) END AS from_lat,
               CASE WHEN event_type IN ('view', 'click', 'purchase') AND user_id % 5 = 0
                    THEN CAST(18.30 AS DOUBLE)
                    + CAST((user_id * 2741) % 1000 AS DOUBLE) * CAST(0.0007 AS DOUBLE)
                    + CAST(user_id // 200 // 100 AS DOUBLE) * CAST(0.8 AS DOUBLE) END AS from_lon,
               (3 * event_id + 2) % greatest(50, (SELECT count(*) FROM part) // 40) AS to_stop_id,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 6 AS option_count,
               CAST(floor(value * 10) AS BIGINT) AS duration_ms, ts AS searched_at
        FROM events""",
    "search_analytics_option": """
        SELECT id AS search_id,
               lpad(CAST((coalesce(from_stop_id, 0) + i) % 400 AS VARCHAR), 6, '0') AS timetable_number,
               'LINE ' || ((coalesce(from_stop_id, 0) + i) % 400) AS route_label,
               'WEEKDAY' AS day_type, CAST(i AS INTEGER) AS departure_count
        FROM (SELECT id, from_stop_id, unnest(range(1, option_count + 1)) AS i
              FROM search_analytics)""",
    # Stop-to-stop requests: every logged search, asked between stops.
    "od": """
        SELECT event_id AS request_id, (7 * user_id + 1) % (SELECT count(*) FROM part) AS from_id,
               (3 * event_id + 2) % greatest(50, (SELECT count(*) FROM part) // 40) AS to_id
        FROM events""",
    "pair": "SELECT DISTINCT from_id, to_id FROM od",
    "ride": """
        SELECT p.from_id, p.to_id, a.schedule_id, a.trip_index, a.stop_sequence AS from_seq,
               b.stop_sequence AS to_seq, a.cell_type AS board_type, a.dep_min AS dep,
               a.raw_value AS dep_raw, a.note_code AS board_note, b.cell_type AS arrive_type,
               b.dep_min AS arr, b.raw_value AS arr_raw, a.prior_min, a.next_min,
               b.prior_min AS arr_prior, b.next_min AS arr_next
        FROM pair p JOIN visit a ON a.stop_id = p.from_id
        JOIN visit b ON b.stop_id = p.to_id AND b.schedule_id = a.schedule_id
                    AND b.trip_index = a.trip_index AND b.stop_sequence > a.stop_sequence""",
    # Distinct rides between any two stops, used by the change-of-bus checks.
    "hop": """
        SELECT a.stop_id AS s, b.stop_id AS e, a.schedule_id AS sched, a.trip_index AS trip,
               a.stop_sequence AS from_seq, b.stop_sequence AS to_seq, a.cell_type AS s_type,
               b.cell_type AS e_type, a.dep_min AS dep, a.raw_value AS dep_raw, b.dep_min AS arr,
               b.raw_value AS arr_raw, v.day_type, v.direction_label AS route,
               v.timetable_number AS ttn
        FROM visit a JOIN visit b ON b.schedule_id = a.schedule_id AND b.trip_index = a.trip_index
                                 AND b.stop_sequence > a.stop_sequence
        JOIN service v ON v.schedule_id = a.schedule_id""",
    "onward": """
        SELECT DISTINCT a.stop_id AS s, b.stop_id AS e
        FROM schedule_stop a JOIN schedule_stop b ON b.schedule_id = a.schedule_id
                                                 AND b.stop_sequence > a.stop_sequence""",
    "leg1": """
        SELECT * FROM hop
        WHERE s IN (SELECT from_id FROM pair) AND e_type = 'TIME' AND (dep IS NULL OR arr > dep)
        QUALIFY row_number() OVER (PARTITION BY s, e, day_type, route, dep, arr
                                   ORDER BY sched, trip, from_seq, to_seq) = 1""",
    "leg9": """
        SELECT * FROM hop
        WHERE e IN (SELECT to_id FROM pair) AND s_type = 'TIME' AND (arr IS NULL OR arr > dep)
        QUALIFY row_number() OVER (PARTITION BY s, e, day_type, route, dep, arr_raw
                                   ORDER BY sched, trip, from_seq, to_seq) = 1""",
    "middle": """
        SELECT p.from_id, p.to_id, m.s AS x, m.e AS y
        FROM pair p JOIN onward a ON a.s = p.from_id
        JOIN onward z ON z.e = p.to_id
        JOIN onward m ON m.s = a.e AND m.e = z.s
        WHERE m.s <> m.e AND m.s <> p.to_id AND m.e <> p.from_id""",
    "leg5": """
        SELECT * FROM hop
        WHERE s_type = 'TIME' AND e_type = 'TIME' AND arr > dep
          AND (s, e) IN (SELECT x, y FROM middle)
        QUALIFY row_number() OVER (PARTITION BY s, e, day_type, route, dep, arr
                                   ORDER BY sched, trip, from_seq, to_seq) = 1""",
    "two": """
        SELECT p.from_id, p.to_id, a.day_type, a.e AS x, a.dep_raw AS dep_raw1, a.dep AS dep1,
               a.arr AS arr1, a.sched AS sched1, a.trip AS trip1, a.from_seq AS from_seq1,
               a.to_seq AS to_seq1, a.route AS route1, a.ttn AS ttn1, b.route AS route2,
               b.ttn AS ttn2, b.dep AS dep2, b.arr_raw AS arr_raw2, b.sched AS sched2,
               b.trip AS trip2, b.from_seq AS from_seq2, b.to_seq AS to_seq2,
               b.dep - a.arr AS wait_minutes, coalesce(b.arr, b.dep) - a.dep AS total_minutes,
               row_number() OVER (PARTITION BY p.from_id, p.to_id ORDER BY
                   coalesce(b.arr, b.dep) - a.dep NULLS LAST, b.dep - a.arr, a.arr, a.day_type,
                   a.e, a.sched, a.trip, a.from_seq, a.to_seq, b.sched, b.trip, b.from_seq,
                   b.to_seq) AS n
        FROM pair p JOIN leg1 a ON a.s = p.from_id
        JOIN leg9 b ON b.e = p.to_id AND b.s = a.e AND b.day_type = a.day_type
                   AND b.dep >= a.arr + 10
        QUALIFY n <= 6""",
    "three": """
        SELECT p.from_id, p.to_id, a.day_type, p.x, p.y, a.dep_raw AS dep_raw1, a.dep AS dep1,
               a.arr AS arr1, a.sched AS sched1, a.trip AS trip1, a.from_seq AS from_seq1,
               a.to_seq AS to_seq1, a.route AS route1, a.ttn AS ttn1,
               b.route AS route2, b.ttn AS ttn2, b.dep AS dep2, b.arr AS arr2, b.sched AS sched2,
               b.trip AS trip2, b.from_seq AS from_seq2, b.to_seq AS to_seq2,
               c.route AS route3, c.ttn AS ttn3, c.dep AS dep3, c.arr_raw AS arr_raw3,
               c.sched AS sched3, c.trip AS trip3, c.from_seq AS from_seq3, c.to_seq AS to_seq3,
               b.dep - a.arr + c.dep - b.arr AS wait_minutes,
               coalesce(c.arr, c.dep) - a.dep AS total_minutes,
               row_number() OVER (PARTITION BY p.from_id, p.to_id ORDER BY
                   coalesce(c.arr, c.dep) - a.dep NULLS LAST, b.dep - a.arr + c.dep - b.arr, a.arr,
                   a.day_type, p.x, p.y, a.sched, a.trip, a.from_seq, a.to_seq, b.sched, b.trip,
                   b.from_seq, b.to_seq, c.sched, c.trip, c.from_seq, c.to_seq) AS n
        FROM middle p JOIN leg1 a ON a.s = p.from_id AND a.e = p.x
        JOIN leg5 b ON b.s = p.x AND b.e = p.y AND b.day_type = a.day_type AND b.dep >= a.arr + 10
        JOIN leg9 c ON c.s = p.y AND c.e = p.to_id AND c.day_type = a.day_type
                   AND c.dep >= b.arr + 10
        WHERE (p.from_id, p.to_id) NOT IN (SELECT from_id, to_id FROM two)
        QUALIFY n <= 6""",
    # Pins: one per supplier.
    "pin": """
        SELECT s_suppkey AS request_id,
               CAST(-34.10 AS DOUBLE) + CAST((s_suppkey * 3571) % 1000 AS DOUBLE)
                   * CAST(0.0005 AS DOUBLE)
                   + CAST((s_suppkey // 200) % 100 AS DOUBLE) * CAST(0.6 AS DOUBLE) AS lat,
               CAST(18.30 AS DOUBLE) + CAST((s_suppkey * 2741) % 1000 AS DOUBLE)
                   * CAST(0.0007 AS DOUBLE)
                   + CAST(s_suppkey // 200 // 100 AS DOUBLE) * CAST(0.8 AS DOUBLE) AS lon
        FROM supplier""",
    "pin_seg": """
        SELECT p.request_id, g.from_stop_id, g.to_stop_id, g.m1, g.m2,
               p.lat AS plat, p.lon AS plon, from_lat, from_lon, mid_lat, mid_lon, to_lat, to_lon,
               cos(radians((from_lat + mid_lat) / 2)) AS k1, cos(radians((mid_lat + to_lat) / 2)) AS k2
        FROM pin p JOIN leg_geometry g
          ON p.lat BETWEEN g.min_lat - (700.0 / 111000.0 + 0.001) AND g.max_lat + (700.0 / 111000.0 + 0.001)
         AND p.lon BETWEEN g.min_lon - (700.0 / 111000.0 + 0.001) AND g.max_lon + (700.0 / 111000.0 + 0.001)""",
    "pin_foot": """
        SELECT *,
               CASE WHEN u1x * u1x + u1y * u1y = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
                   (q1x * u1x + q1y * u1y) / (u1x * u1x + u1y * u1y))) END AS t1,
               CASE WHEN u2x * u2x + u2y * u2y = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
                   (q2x * u2x + q2y * u2y) / (u2x * u2x + u2y * u2y))) END AS t2
        FROM (SELECT *, 6371000.0 * radians(mid_lon - from_lon) * k1 AS u1x,
                     6371000.0 * radians(mid_lat - from_lat) AS u1y,
                     6371000.0 * radians(plon - from_lon) * k1 AS q1x,
                     6371000.0 * radians(plat - from_lat) AS q1y,
                     6371000.0 * radians(to_lon - mid_lon) * k2 AS u2x,
                     6371000.0 * radians(to_lat - mid_lat) AS u2y,
                     6371000.0 * radians(plon - mid_lon) * k2 AS q2x,
                     6371000.0 * radians(plat - mid_lat) AS q2y
              FROM pin_seg)""",
    "pin_leg": """
        SELECT request_id, from_stop_id, to_stop_id, round(d, 1) AS distance_m,
               round(greatest(0.0, least(1.0, walked / (m1 + m2))), 4) AS fraction
        FROM (SELECT *, CASE WHEN d2 < d1 THEN d2 ELSE d1 END AS d,
                     CASE WHEN d2 < d1 THEN m1 + t2 * m2 ELSE t1 * m1 END AS walked
              FROM (SELECT *, sqrt(pow(q1x - t1 * u1x, 2) + pow(q1y - t1 * u1y, 2)) AS d1,
                           sqrt(pow(q2x - t2 * u2x, 2) + pow(q2y - t2 * u2y, 2)) AS d2
                    FROM pin_foot))
        WHERE d <= 700""",
    "pin_anchor": """
        SELECT l.request_id, a.schedule_id, a.trip_index, a.stop_sequence + l.fraction AS position,
               CASE WHEN a.dep_min IS NOT NULL AND b.dep_min IS NOT NULL
                    THEN a.dep_min + l.fraction * (b.dep_min - a.dep_min)
                    ELSE coalesce(a.dep_min, b.dep_min) END AS minutes,
               l.distance_m, l.from_stop_id, l.to_stop_id
        FROM pin_leg l
        JOIN visit a ON a.stop_id = l.from_stop_id
        JOIN visit b ON b.stop_id = l.to_stop_id AND b.schedule_id = a.schedule_id
                    AND b.trip_index = a.trip_index AND b.stop_sequence = a.stop_sequence + 1""",
}




def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with every table it reads defined in front of it."""
    pool = {**TABLES, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text)) & set(pool)):
            if name not in order:
                visit(pool[name])
                order.append(name)
    visit(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({pool[n].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}"


def hhmm(m: str) -> str:
    return (f"lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(CAST({m} % 60 AS VARCHAR), 2, '0')")
