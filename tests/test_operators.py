"""Operators on small hand-made networks and against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tripweave.operators import connect, diff, enrich, itinerary, locate, merge, planner
from tripweave.plans import requests as R
from tripweave.plans.ingest import parsed
from tripweave.plans.upkeep import current_manifest
from tripweave.sources import manifest as M
from tripweave.sources.network import load, visits
from tripweave.sources.tables import SCHEMAS, Tables, from_parquet, to_parquet

SF = "/root/testdata/sf0.001"


def network(spark, schedules, placed=True):
    """schedules: {id: (label, day, stops, trips)} with trips as lists of minutes, None for
    via, "-" for not served."""
    stops, sc, ss, st = set(), [], [], []
    for i, (label, day, names, trips) in schedules.items():
        sc.append((i, i, 1, 0, label, day, day, None, None, False))
        for q, s in enumerate(names):
            stops.add(s)
            ss.append((i, q, s))
            for j, trip in enumerate(trips):
                m = trip[q]
                kind = "NONE" if m == "-" else "VIA" if m is None else "TIME"
                raw = {"NONE": "--", "VIA": "via"}.get(kind) or f"{m // 60:02d}:{m % 60:02d}"
                st.append((i, j, q, s, kind, m if kind == "TIME" else None, None, raw))

    def df(rows, name):
        return spark.createDataFrame(rows, SCHEMAS[name])
    tt = [(i, 1, f"{i:06d}", False, None, None, "", f"T{i}.pdf", None, 1, "parsed", None, None, None)
          for i in schedules]
    t = {"schedule": df(sc, "schedule"), "schedule_stop": df(ss, "schedule_stop"),
         "stop_time": df(st, "stop_time"), "timetable": df(tt, "timetable"),
         "stop": df([(s, f"S{s}", -34.0 + s * 0.001 if placed else None, 18.5 if placed else None, None, None)
                     for s in sorted(stops)], "stop"),
         "leg_geometry": df([], "leg_geometry")}
    t["visit"] = visits(t["stop_time"])
    return Tables(spark, {n: (lambda d=d: d) for n, d in t.items()})


def test_via_floor_uses_latest_before_and_earliest_after(spark):
    # Printed backwards: the time before (700) is past the time after (600), so no floor.
    t = network(spark, {1: ("A", "WEEKDAY", [1, 2, 3, 4, 5], [[500, None, 700, None, 600]])})
    got = {r["stop_id"]: (r["minutes"], r["raw"], r["approx"]) for r in planner.stop_anchors(
        t, spark.createDataFrame([(2,), (4,)], "stop_id long")).collect()}
    assert got == {2: (500.0, "from 08:20", True), 4: (None, "via", False)}


def test_boarding_takes_the_first_position_even_if_it_cannot_pair(spark):
    # Stop 1 twice: the first visit has no later visit of 2 in time, so the trip is dropped.
    t = network(spark, {1: ("A", "WEEKDAY", [1, 2, 1], [[600, 500, 400]])})
    req = spark.createDataFrame([(7, 1, None, None, 2, None, None)], "request_id long, from_stop_id long, "
                                "from_lat double, from_lon double, to_stop_id long, to_lat double, to_lon double")
    assert planner.plan(t, req).departures.count() == 0


def test_connections_prefer_fewer_buses_and_respect_the_buffer(spark):
    t = network(spark, {
        1: ("L1", "WEEKDAY", [1, 2], [[None, 600]]),            # boards at a via
        2: ("L2", "WEEKDAY", [2, 3], [[609, 640], [610, 650]]),  # 609 is too tight
        3: ("L3", "SUNDAY", [2, 3], [[700, 720]]),               # another day
        4: ("L4", "WEEKDAY", [3, 4], [[660, None]])})
    req = spark.createDataFrame([(1, 1, 3), (2, 1, 4), (3, 4, 1), (4, 1, 99)],
                                "request_id long, from_id long, to_id long")
    c = connect.connections(t, req)
    status = {r["request_id"]: (r["status"], r["legs_required"], r["connection_count"]) for r in c.status.collect()}
    assert status == {1: ("ok", 2, 1), 2: ("ok", 3, 1), 3: ("ok", None, 0), 4: ("stop not found", None, 0)}
    legs = sorted(c.legs.filter("request_id = 2").collect(), key=lambda r: r["leg_no"])
    assert [r["wait_minutes"] for r in legs] == [20] * 3 and legs[0]["total_minutes"] is None
    assert legs[0]["board_raw"] == "via" and legs[2]["arrive_raw"] == "via" and legs[2]["arrive_minutes"] is None
    # Other paths of the plan agree on who can be connected at all.
    assert connect.change_points(c.legs).filter("request_id = 1").first()["change_at"] == "S2"


def test_long_schedule_is_cut_into_blocks(spark):
    """One trip longer than a block: floors and travel order stay exact across the cut."""
    n = 4096 + 50
    minutes = [300] + [None] * (n - 2) + [1000]
    t = network(spark, {1: ("A", "WEEKDAY", list(range(n)), [minutes])})
    v = t.visit.agg(F.min("prior_min"), F.max("prior_min"), F.min("next_min"), F.max("next_min"),
                    F.count("prior_min"), F.count("next_min")).first()
    assert tuple(v) == (300, 300, 1000, 1000, n - 1, n - 1)


def _pin_brute(t, pins, threshold=700.0):
    out = {}
    legs = t.leg_geometry.collect()
    deg = threshold / 111000.0 + 0.001
    rad, earth = math.radians, 6371000.0

    def hav(a, b):
        s = math.sin(rad(b[0] - a[0]) / 2) ** 2 + math.cos(rad(a[0])) * math.cos(rad(b[0])) * math.sin(
            rad(b[1] - a[1]) / 2) ** 2
        return 2 * earth * math.asin(math.sqrt(s))
    for rid, la, lo in pins:
        for g in legs:
            if not (g["min_lat"] - deg <= la <= g["max_lat"] + deg and g["min_lon"] - deg <= lo <= g["max_lon"] + deg):
                continue
            best, walked, done = math.inf, 0.0, 0.0
            for a, b in zip(g["path"], g["path"][1:]):
                k = math.cos(rad((a[0] + b[0]) / 2)) * earth
                d = (rad(b[1] - a[1]) * k, rad(b[0] - a[0]) * earth)
                p = (rad(lo - a[1]) * k, rad(la - a[0]) * earth)
                q = d[0] ** 2 + d[1] ** 2
                f = 0.0 if q == 0 else max(0.0, min(1.0, (p[0] * d[0] + p[1] * d[1]) / q))
                off = math.hypot(p[0] - f * d[0], p[1] - f * d[1])
                m = hav(a, b)
                if off < best:
                    best, walked = off, done + f * m
                done += m
            if best <= threshold:
                total = g["length_m"] or done
                out[rid, g["from_stop_id"], g["to_stop_id"]] = (best, walked / total if total else 0.0)
    return out


def test_locate_matches_brute_force(spark):
    t = load(spark, SF)
    random.seed(5)
    pins = [(i, -34.1 + random.random() * 0.5, 18.3 + random.random() * 0.7) for i in range(40)]
    got = locate.locate(t, spark.createDataFrame(pins, "request_id long, lat double, lon double")).collect()
    want = _pin_brute(t, pins)
    assert {(r["request_id"], r["from_stop_id"], r["to_stop_id"]) for r in got} == set(want)
    for r in got:
        d, f = want[r["request_id"], r["from_stop_id"], r["to_stop_id"]]
        assert abs(r["distance_m"] - d) <= 0.0501 and abs(r["fraction"] - f) <= 0.0000501


@pytest.mark.parametrize("block, short", [(4096, 64), (5, 0), (7, 3)])
def test_locate_on_long_paths_and_among_crowded_pins(spark, monkeypatch, block, short):
    """A winding path of many points and short ones; most pins stand in one street, one far off."""
    monkeypatch.setattr(locate, "BLOCK", block)
    monkeypatch.setattr(locate, "SHORT", short)
    rnd = random.Random(3)

    def leg(i, points):
        lats, lons = zip(*points)
        return (i, i + 1, points, None, min(lats), min(lons), max(lats), max(lons), "x", None)
    wind = [(-34.0 + k * 0.0004, 18.5 + 0.02 * math.sin(k / 9)) for k in range(600)]
    legs = [leg(1, wind), leg(3, [(-34.0, 18.4), (-33.7, 18.9)]), leg(5, [(-33.99, 18.5), (-33.99, 18.5)])]
    legs += [leg(10 + i, [(-34 + rnd.random() * 0.4, 18.3 + rnd.random() * 0.6) for _ in range(rnd.choice([2, 3, 9]))])
             for i in range(30)]
    t = Tables(spark, {"leg_geometry": lambda: spark.createDataFrame(legs, SCHEMAS["leg_geometry"])})
    pins = [(i, -33.99 + rnd.random() * 0.004, 18.5 + rnd.random() * 0.004) for i in range(150)]
    pins += [(200 + i, -34 + rnd.random() * 0.4, 18.3 + rnd.random() * 0.6) for i in range(30)] + [(999, 10.0, 10.0)]
    got = locate.locate(t, spark.createDataFrame(pins, "request_id long, lat double, lon double")).collect()
    want = _pin_brute(t, pins)
    assert {(r["request_id"], r["from_stop_id"], r["to_stop_id"]) for r in got} == set(want) and len(want) > 200
    for r in got:
        d, f = want[r["request_id"], r["from_stop_id"], r["to_stop_id"]]
        assert abs(r["distance_m"] - d) <= 0.0501 and abs(r["fraction"] - f) <= 0.0000501


def test_road_path_is_trimmed_and_joined(spark):
    t = network(spark, {1: ("A", "WEEKDAY", [1, 2, 3], [[600, 610, 620]])})
    leg = spark.createDataFrame([(1, 2, [(-33.999, 18.5), (-33.9985, 18.51), (-33.998, 18.5)], None, -33.999,
                                  18.5, -33.998, 18.51, "x", None)], SCHEMAS["leg_geometry"])
    t = t.replacing(leg_geometry=leg)
    none = None
    req = spark.createDataFrame([(1, 1, none, none, 3, none, none)],
                                "request_id long, from_stop_id long, from_lat double, from_lon double, "
                                "to_stop_id long, to_lat double, to_lon double")
    rows = sorted(planner.plan(t, req).road_points.collect(), key=lambda r: (r["leg_no"], r["point_no"]))
    # Leg 1-2 has a road of three points; leg 2-3 runs straight and does not repeat stop 2.
    assert [(r["leg_no"], round(r["lat"], 4)) for r in rows] == [
        (0, -33.999), (0, -33.9985), (0, -33.998), (1, -33.997)]


def test_reload_keeps_ids_and_counts(spark):
    t, m = load(spark, SF), current_manifest(spark, SF)
    ledger = m.select("pdf_filename", F.lit("x").alias("sha256"), F.lit(True).alias("ok"),
                      F.lit(None).cast("string").alias("error"))
    at = F.lit("2026-02-01 00:00:00").cast("timestamp")
    names = ["route", "stop", "timetable", "timetable_note", "schedule", "schedule_stop"]
    p = parsed(spark, SF)
    once = merge.load_batch(t, m, ledger, p, at)
    twice = merge.load_batch(once, m, ledger, p, at)
    a, b = ({r[0]: r[1] for r in merge.table_counts(x, names).collect()} for x in (once, twice))
    assert a == b
    ids = [{(r[0], r[1]) for r in x.timetable.select("pdf_filename", "id").collect()} for x in (t, once, twice)]
    assert ids[0] == ids[1] == ids[2]


def test_empty_manifest_is_refused(spark):
    t = load(spark, SF)
    empty = current_manifest(spark, SF).limit(0)
    with pytest.raises(ValueError):
        merge.prune_superseded(t, empty)
    with pytest.raises(ValueError):
        M.unpublished_files(empty, empty)


def test_manifest_grammar(spark, tmp_path):
    paths = ["Pdf/Zpdf/ZZZ_TEST___SAMPLE_from_20260622_to_99999999_999999.pdf",
             "Pdf/Apdf/A_B___C___PH_20260801_000101.pdf", "Pdf/Apdf/readme.pdf",
             "Other/Zpdf/ZZZ_TEST___SAMPLE_from_20260622_to_99999999_999999.pdf"]
    df = spark.createDataFrame(list(enumerate(paths)), "listing_pos long, pdf_path string")
    rows = {r["pdf_filename"]: r for r in M.manifest_rows(df, "https://x/").collect()}
    z = rows["ZZZ_TEST___SAMPLE_from_20260622_to_99999999_999999.pdf"]
    assert (z["route_name"], z["origin"], z["destination"], z["letter_group"]) == (
        "ZZZ TEST-SAMPLE", "ZZZ TEST", "SAMPLE", "Z")
    assert z["effective_from"] == "2026-06-22" and z["effective_to"] is None and not z["is_public_holiday"]
    assert z["pdf_url"] == "https://x/" + paths[0]
    h = rows["A_B___C___PH_20260801_000101.pdf"]
    assert h["is_public_holiday"] and h["timetable_number"] == "000101" and h["route_name"] == "A B-C"
    assert [r["pdf_path"] for r in M.rejected_paths(df).collect()] == [paths[2]]
    M.write_manifest(M.manifest_rows(df, "https://x"), str(tmp_path / "m"))
    assert M.read_manifest(spark, str(tmp_path / "m")).count() == 2


def test_file_ledger_reads_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    m = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "pdf_filename string")
    files = M.read_files(spark, str(tmp_path))
    got = {r["pdf_filename"]: r for r in M.file_ledger(m, files).collect()}
    assert got["a.pdf"]["ok"] and got["a.pdf"]["size"] == 10 and not got["a.pdf"]["skipped"]
    assert got["b.pdf"]["error"] == "response is not a PDF" and got["c.pdf"]["error"] == "not downloaded"
    again = M.file_ledger(m, files, M.file_ledger(m, files))
    assert {r[0]: r[1] for r in M.stage_summary(again).collect()} == {"skipped": 1, "failed": 2}


def test_conflicts(spark):
    rows = [(1, 0, "WEEKDAY", 600, 700), (1, 1, "WEEKDAY", 690, 800), (1, 2, "SUNDAY", 10, 20),
            (2, 0, "WEEKDAY", 1300, 1430), (2, 1, "WEEKDAY", 30, 60)]
    df = spark.createDataFrame(rows, "itinerary_id long, position long, day_type string, "
                                     "board_minutes int, arrive_minutes int")
    assert [tuple(r) for r in itinerary.conflicts(df).collect()] == [(1, 1, 10)]


def test_result_diff(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k long, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, 2.5, None), (4, 3.0, "z")], "k long, v double, s string")
    got = {(r["k"], r["column_name"]) for r in diff.result_diff(a, b, ["k"]).collect()}
    assert got == {(2, "v"), (3, "*"), (4, "*")}
    assert diff.result_diff(a, a, ["k"]).count() == 0


def test_only_buckets_that_differ_are_compared(spark):
    """Planted: a changed value, a null that moves to the next column, a row too many, a row twice."""
    rows = [(i, i * 0.5, f"s{i % 5}", None) for i in range(5000)]
    a = spark.createDataFrame(rows, "k long, v double, s string, u string")
    changed = [r for r in rows]
    changed[10], changed[20] = (10, 5.5, "s0", None), (20, 10.0, None, "s0")
    changed += [(9000, 1.0, "s1", None), rows[30]]
    b = spark.createDataFrame(changed, "k long, v double, s string, u string")
    assert diff.differing_buckets(a, a.orderBy(F.desc("k")), ["k"]).isEmpty()
    assert 1 <= diff.differing_buckets(a, b, ["k"]).count() <= 4
    want = {(10, "v"), (20, "s"), (20, "u"), (9000, "*"), (30, "#")}
    for buckets in (1, 7, 1 << 16):
        assert {(r["k"], r["column_name"]) for r in diff.result_diff(a, b, ["k"], buckets).collect()} == want


def test_snapshot_round_trip(spark, tmp_path):
    t = load(spark, SF)
    to_parquet(t, str(tmp_path / "snap"), ["stop", "schedule"])
    back = from_parquet(spark, str(tmp_path / "snap"))
    assert back.stop.count() == t.stop.count() and back.schedule.count() == t.schedule.count()


def test_paths_from_steps_uses_overview_without_steps(spark):
    df = spark.createDataFrame([(1, 2, 5.0, [], "_p~iF~ps|U_ulLnnqC")], "from_stop_id long, to_stop_id long, "
                               "length_m double, step_lines array<string>, overview_line string")
    got = enrich.paths_from_steps(df).first()["path"]
    assert [tuple(p) for p in got] == [(38.5, -120.2), (40.7, -120.95)]


def test_fixture_cases(spark):
    """Known pairs: nine direct rides, eight after merging by service; two and three buses."""
    from tripweave.operators import journeys as J
    t = load(spark, SF)
    req = spark.createDataFrame([(1, 93, 131), (2, 183, 179), (3, 44, 74)],
                                "request_id long, from_id long, to_id long")
    assert J.pair_rides(t, req.filter("request_id = 1").select("from_id", "to_id")).count() == 9
    assert J.journeys(t, req.filter("request_id = 1")).departures.count() == 8
    c = {r["request_id"]: r["legs_required"] for r in connect.connections(t, req).status.collect()}
    assert c[2] == 2 and c[3] == 3


def test_no_connection_leaves_before_the_buffer(spark):
    t = load(spark, SF)
    legs = connect.connections(t, R.od_requests(spark, SF)).legs
    a = legs.select("request_id", "connection_no", (F.col("leg_no") + 1).alias("leg_no"),
                    F.col("arrive_minutes").alias("got_there"))
    assert legs.join(a, ["request_id", "connection_no", "leg_no"]).filter(
        "board_minutes < got_there + 10").count() == 0


def test_one_order_with_most_lines(spark, tmp_path):
    """A schedule far longer than a block is numbered as one window would number it."""
    import duckdb

    from tripweave.sources.network import derive
    n = 12_000
    rows = spark.range(n).select(
        F.when(F.col("id") < 10_000, 7).otherwise(F.col("id") % 900).cast("bigint").alias("l_orderkey"),
        ((F.col("id") * 7919) % 20_011).alias("l_partkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in derive(spark, str(tmp_path)).schedule_stop.collect()}
    want = duckdb.connect().execute(f"""
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_partkey) - 1, l_partkey
        FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS f
              FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet') GROUP BY 1, 2)""").fetchall()
    assert got == set(want)


def test_leg_geometry_upsert(spark):
    """New paths go over old ones; legs not fetched, or fetched without points, stay."""
    from tripweave.operators.enrich import upsert_leg_geometry
    from tripweave.sources.tables import SCHEMAS
    import datetime as dt

    def leg(a, b, points, day):
        return (a, b, [(float(i), 0.0) for i in range(points)], 1.0 * points, 0.0, 0.0, 0.0, 0.0, "x",
                dt.datetime(2026, 1, day))
    make = lambda rows: spark.createDataFrame(rows, SCHEMAS["leg_geometry"])
    old = make([leg(1, 2, 2, 1), leg(2, 3, 2, 1), leg(3, 4, 2, 1)])
    new = make([leg(1, 2, 5, 2), leg(1, 2, 6, 3), leg(2, 3, 0, 2), leg(9, 9, 3, 2)])
    got = {(r["from_stop_id"], r["to_stop_id"]): len(r["path"]) for r in upsert_leg_geometry(old, new).collect()}
    assert got == {(1, 2): 6, (2, 3): 2, (3, 4): 2, (9, 9): 3}


@pytest.mark.parametrize("search", ["two_bus", "three_bus"])
def test_trimmed_connections_are_exact(spark, search):
    """The best two journeys of a pair are the first two of all its journeys: dropping first
    parts on the way loses none, where many pairs have more than two."""
    t, run = load(spark, SF), getattr(connect, search)
    pairs = R.od_requests(spark, SF).select("from_id", "to_id").distinct()
    every = [tuple(r) for r in run(t, pairs, 10, 1 << 20).collect()]
    at = run(t, pairs, 10, 2).columns.index("_rank")
    assert sum(r[at] > 2 for r in every) > 0
    got = [tuple(r) for r in run(t, pairs, 10, 2).collect()]
    assert sorted(map(str, got)) == sorted(str(r) for r in every if r[at] <= 2)


def _moved(plan, table):
    """Whether a scan of ``table`` has an exchange between it and the join above it."""
    lines = [(len(re.match(r"[\s:+\-|*()\d]*", x)[0]), x) for x in plan.split("\n")]
    out = []
    for i, (depth, line) in enumerate(lines):
        if "Scan parquet" in line and table in line:
            for up, above in reversed(lines[:i]):
                if up < depth:
                    depth = up
                    if "Exchange" in above or "Join" in above:
                        out.append("Exchange" in above)
                        break
    return out


def test_rides_of_pairs_do_not_move_the_visits(spark):
    """Visits lie in buckets of their schedule; what is looked up goes to them."""
    from tripweave.operators.journeys import pair_rides
    t = load(spark, SF)
    pairs = R.od_requests(spark, SF).select("from_id", "to_id").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rides = pair_rides(t, pairs)
        plan = rides._jdf.queryExecution().executedPlan().toString()
        assert _moved(plan, "tripweave_visit") == [False, False]
        few = rides.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert pair_rides(t, pairs).count() == few > 0


def test_buckets_of_a_table(spark):
    from tripweave.session import BUCKET_ROWS, TABLE, stored_in_buckets
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    df = stored_in_buckets(rows, "removable", 10 * BUCKET_ROWS, "x", "id")
    assert sorted(map(tuple, df.collect())) == [(i, i % 7) for i in range(100)]
    name = next(x.name for x in spark.catalog.listTables() if x.name.startswith(f"{TABLE}removable"))
    about = {r[0]: r[1] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    assert about["Num Buckets"] == "10" and about["Bucket Columns"] == "[`x`]"
    spark.sql(f"DROP TABLE {name}")


def test_paths_of_two_changes(spark):
    """Change points of pairs, against all paths; a hub is not multiplied by both of its ends."""
    rnd = random.Random(4)
    lines = {i: rnd.sample(range(30), 4) for i in range(25)}
    t = Tables(spark, {"schedule_stop": lambda: spark.createDataFrame(
        [(i, n, s) for i, line in lines.items() for n, s in enumerate(line)],
        "schedule_id long, stop_sequence long, stop_id long")})
    hops = {(a, b) for line in lines.values() for n, a in enumerate(line) for b in line[n + 1:]}
    pairs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)]
    got = [tuple(r) for r in connect._through(t, spark.createDataFrame(
        sorted(set(pairs)), "from_id long, to_id long")).collect()]
    want = [(a, b, x, y) for a, b in sorted(set(pairs)) for x in range(30) for y in range(30)
            if (a, x) in hops and (x, y) in hops and (y, b) in hops and y != a and x != b]
    assert sorted(got) == want and len(want) > 20


def test_strip_reads_its_rows_once(spark):
    from tripweave.operators.itinerary import trip_strip
    from tripweave.plans.upkeep import _strips
    out = trip_strip(load(spark, SF), _strips(spark, SF))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_tables_in_buckets_stay_where_they_are_in_any_session(spark):
    """Cells meet rides by schedule and trip; only rides move, whatever the session was built with."""
    from tripweave.session import CO_PARTITION
    from tripweave.sources.network import derive
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(CO_PARTITION, "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = derive(spark, SF)
        rides = spark.range(50).select(F.col("id").alias("schedule_id"), F.lit(0).cast("bigint").alias("trip_index"))
        met = t.visit.join(rides, ["schedule_id", "trip_index"])
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        met = t.stop_time.join(t.schedule_stop, ["schedule_id", "stop_sequence"])
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    finally:
        spark.conf.set(CO_PARTITION, "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plan_works_out_what_is_asked_for(spark, monkeypatch):
    """Departures between stops read no pins and no paths."""
    def never(*args, **kwargs):
        raise AssertionError("not asked for")
    monkeypatch.setattr(planner, "locate", never)
    monkeypatch.setattr(planner, "_road_points", never)
    t = network(spark, {1: ("A", "WEEKDAY", [1, 2], [[500, 520], [600, 620]])})
    req = spark.createDataFrame([(7, 1, None, None, 2, None, None)], "request_id long, from_stop_id long, "
                                "from_lat double, from_lon double, to_stop_id long, to_lat double, to_lon double")
    p = planner.plan(t, req)
    assert [r["board_raw"] for r in p.departures.orderBy("trip_index").collect()] == ["08:20", "10:00"]
    assert p.options.count() == 1 and p.segment_stops.count() == 2


def test_board_meets_requests_of_its_day_only(spark):
    """Departures join requests by stop and day at once."""
    from tripweave.operators.catalog import departure_board
    out = departure_board(load(spark, SF), R.each_day(R.stop_requests(spark, SF)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    asked = [x for x in plan.splitlines() if re.search(r"Join Inner, .*stop_id", x)]
    assert asked and all("day_type" in x for x in asked)


def test_names_come_after_requests_have_met_their_rides(spark):
    from tripweave.operators.trips import trip_stops
    plan = trip_stops(load(spark, SF), R.ride_requests(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "stop_id" in next(x for x in plan.splitlines() if "Join Inner" in x)


def test_rides_that_differ_are_told_apart_by_digests(spark, monkeypatch):
    """Only rides alike in times and texts are compared row by row."""
    t = network(spark, {1: ("A", "WEEKDAY", [1, 2], [[500, 520], [600, 620], [500, 520]]),
                        2: ("B", "WEEKDAY", [1, 2], [[500, 520]]), 3: ("C", "WEEKDAY", [1, 3], [[500, 520]])})
    seen, keep = {}, diff.stored

    def spy(df, name, *sort):
        seen[name] = keep(df, name, *sort)
        return seen[name]
    monkeypatch.setattr(diff, "stored", spy)
    pairs = {1: ((1, 0), (1, 1)), 2: ((1, 0), (1, 2)), 3: ((1, 0), (2, 0)), 4: ((1, 0), (3, 0)), 5: ((3, 0), (3, 0)),
             6: ((9, 0), (9, 0))}
    df = spark.createDataFrame([(k, *a, 0, 9, *b, 0, 9) for k, (a, b) in pairs.items()], "pair_id long, " + ", ".join(
        f"{p}_{c} long" for p in "ab" for c in ("schedule_id", "trip_index", "from_seq", "to_seq")))
    got = {r["pair_id"]: r["same"] for r in diff.equal_breakdowns(t, df).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False}
    assert {r["pair_id"] for r in seen["close"].collect()} == {2, 3, 4}


def test_points_meet_stops_with_a_bus_only(spark, monkeypatch):
    t = network(spark, {1: ("A", "WEEKDAY", [1, 2, 3], [[500, 520, 540]]), 2: ("B", "SUNDAY", [4, 5], [[500, 520]])})
    seen, near = [], planner.stops_near

    def spy(t, points, radius, among, *same):
        seen.extend((r["stop_id"], r["to_id"]) for r in among.collect())
        return near(t, points, radius, among, *same)
    monkeypatch.setattr(planner, "stops_near", spy)
    req = spark.createDataFrame([(1, -33.99, 18.5, 3, None, None)], "request_id long, lat double, lon double, "
                                "to_id long, exclude_id long, day_type string")
    got = [(r["rank"], r["stop_id"], r["trip_count"]) for r in planner.nearby_origins(t, req).collect()]
    assert got == [(1, 2, 1), (2, 1, 1)]
    assert sorted(seen) == [(1, 3), (2, 3)]


def test_origins_pick_rows_before_cells(spark):
    from tripweave.operators.journeys import reachable_untimed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reachable_untimed(load(spark, SF), R.stop_requests(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"Exchange [^\n]*\n(?:[^\n]*(?:Project|Filter|ColumnarToRow)[^\n]*\n)*[^\n]*tripweave_visit", plan)
    assert not moved
