"""Strips of trips are put together where their request's rows lie."""

from __future__ import annotations

from tripweave.operators.itinerary import trip_strip
from tripweave.plans.upkeep import _strips
from tripweave.sources.network import load

SF = "/root/testdata/sf0.001"


def test_rows_of_a_request_move_once(spark):
    asked = _strips(spark, SF).filter("request_id < 400")
    both = asked.union(asked.withColumn("request_id", asked["request_id"] + 10**6))
    out = trip_strip(load(spark, SF), both)
    # Ends are gathered and met in the buckets that the rows were written to.
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {}
    for r in out.collect():
        rows.setdefault(r["request_id"] // 10**6, []).append((r["request_id"] % 10**6, *r[1:]))
    assert sorted(rows[0]) == sorted(rows[1]) and len(rows[0]) > 300
