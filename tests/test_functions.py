"""Scalar and geometry expressions against known values."""

import math

import pytest
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.functions import scalars as S
from tripweave.operators.enrich import decode_batch


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("m,text", [(365, "06:05"), (1439, "23:59"), (0, "00:00"), (None, None)])
def test_clock(spark, m, text):
    assert one(spark, S.clock(F.lit(m).cast("int"))) == text


@pytest.mark.parametrize("m,text", [(365.0, "06:05"), (365.4, "06:05"), (1500.0, "01:00"),
                                    (0.5, "00:00"), (1.5, "00:02"), (2.5, "00:02"), (None, None)])
def test_clock_rounded(spark, m, text):
    assert one(spark, S.clock_rounded(F.lit(m).cast("double"))) == text


def test_to_minutes(spark):
    assert one(spark, S.to_minutes(F.lit("06:05"))) == 365


@pytest.mark.parametrize("x,n,want", [(2.25, 1, 2.2), (2.35, 1, 2.4), (0.15, 1, 0.2), (2.5, 0, 2.0),
                                      (0.5, 0, 0.0), (1.5, 0, 2.0)])
def test_half_even(spark, x, n, want):
    assert one(spark, S.half_even(F.lit(x), n)) == want


@pytest.mark.parametrize("day,rank", [("WEEKDAY", 0), ("SATURDAY", 1), ("SUNDAY", 2),
                                      ("PUBLIC_HOLIDAY", 3), ("OTHER", 9), (None, 9)])
def test_day_rank(spark, day, rank):
    assert one(spark, S.day_rank(F.lit(day).cast("string"))) == rank


def test_bus_sign(spark):
    r = one(spark, S.bus_sign(F.lit("TOWN - MALL -  - PORT - BAY")))
    assert (r["origin"], r["terminus"], r["via"]) == ("TOWN", "BAY", "MALL, PORT")
    r = one(spark, S.bus_sign(F.lit(" - ")))
    assert (r["origin"], r["terminus"], r["via"]) == (" - ", " - ", "")


@pytest.mark.parametrize("m,text", [(None, "time not published"), (45, "45 min"), (60, "1 h"), (220, "3 h 40")])
def test_duration(spark, m, text):
    assert one(spark, S.duration_text(F.lit(m).cast("int"))) == text


@pytest.mark.parametrize("b,a,part", [(719, None, "morning"), (720, 1, "afternoon"), (None, 1020, "evening"),
                                      (None, None, "other")])
def test_daypart(spark, b, a, part):
    assert one(spark, S.daypart(F.lit(b).cast("int"), F.lit(a).cast("int"))) == part


def path(*points):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points])


def empty():
    return F.expr("cast(array() as array<struct<lat:double,lon:double>>)")


METRES = math.radians(1) * 6_371_000  # of a degree along a meridian


def test_haversine(spark):
    d = one(spark, geo.haversine_m(F.lit(3.0), F.lit(7.0), F.lit(3.5), F.lit(7.0)))
    assert d == pytest.approx(METRES / 2, rel=1e-6)
    d = one(spark, geo.haversine_m(F.lit(60.0), F.lit(0.0), F.lit(60.0), F.lit(0.02)))
    assert d == pytest.approx(METRES * 0.02 * math.cos(math.radians(60)), rel=1e-4)


def test_point_to_segment(spark):
    f = [F.lit(x) for x in (0.002, 0.003, 0.0, 0.0, 0.0, 0.012)]
    r = one(spark, geo.point_to_segment(*f))
    assert r["t"] == pytest.approx(0.25, abs=0.01) and r["d"] == pytest.approx(0.002 * METRES, rel=0.01)
    f = [F.lit(x) for x in (0.0, -0.004, 0.0, 0.0, 0.0, 0.012)]
    assert one(spark, geo.point_to_segment(*f))["t"] == 0.0


def test_locate_on_path(spark):
    at = lambda p, m, la, lo: one(spark, geo.locate_on_path(p, F.lit(m).cast("double"), F.lit(la), F.lit(lo)))
    bend = path((0, 0), (0, 0.03), (0.01, 0.03))
    r = at(bend, None, 0.001, 0.01)
    assert r["fraction"] == pytest.approx(0.25, abs=0.01) and r["distance"] == pytest.approx(0.001 * METRES, rel=0.01)
    r = at(bend, None, 0.005, 0.032)
    assert r["fraction"] == pytest.approx(0.875, abs=0.01) and r["distance"] == pytest.approx(0.002 * METRES, rel=0.01)
    assert at(empty(), None, 0.0, 0.0)["distance"] == math.inf
    assert at(path((2, 3)), None, 2.0, 3.01)["fraction"] == 0.0


def sliced(spark, p, s, e):
    return [(q["lat"], q["lon"]) for q in one(spark, geo.slice_path(p, F.lit(float(s)), F.lit(float(e))))]


def test_slice_path(spark):
    bend = path((0, 0), (0, 0.03), (0.01, 0.03))      # three quarters east, then north
    assert sliced(spark, bend, 0, 1) == [(0, 0), (0, 0.03), (0.01, 0.03)]
    part = sliced(spark, bend, 0.375, 0.875)
    assert part[0][1] == pytest.approx(0.015, abs=1e-5) and part[1] == (0, 0.03)
    assert part[2][0] == pytest.approx(0.005, abs=1e-5)
    assert len(sliced(spark, bend, 0.1, 0.6)) == 2
    assert sliced(spark, empty(), 0.1, 0.9) == []
    assert sliced(spark, path((4, 5)), 0.1, 0.9) == [(4, 5)]
    assert sliced(spark, bend, 0.9, 0.1) == []
    assert sliced(spark, path((7, 7), (7, 7)), 0.1, 0.9) == [(7, 7)]


def test_join_paths(spark):
    a = F.array(path((0, 0), (0, 1)), path((0, 1), (0, 2)), path((5, 5)))
    assert [tuple(p) for p in one(spark, geo.join_paths(a))] == [(0, 0), (0, 1), (0, 2), (5, 5)]


def test_polylines_decode_in_one_batch():
    """Against lines written out here by hand: 0 is '?', 1 is 'A', -1 is '@', 16 is '_@'."""
    got = decode_batch(["", "??A@", "_@?", "", "@@AAAA"])
    want = [[], [(0, 0), (1, -1)], [(16, 0)], [], [(-1, -1), (0, 0), (1, 1)]]
    assert [[(round(a * 1e5), round(b * 1e5)) for a, b in p.tolist()] for p in got] == want
    assert decode_batch([]) == []
