"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Queries run over a loaded network, as the published figures do; loading is timed on its
own. Result rows are all produced and dropped (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import time

from tripweave.plans import every_query
from tripweave.session import build_session
from tripweave.sources.network import load

HEADLINE = [
    "direct_departures", "journey_options", "plan_stop_to_stop", "locate_pins", "plan_pins",
    "reachable_from_pins", "two_leg_connections", "connections_cascade", "reachable_matrix",
    "stop_anchors_via_floor", "trip_travel_order", "departure_board", "timetable_payload",
    "nearby_origins", "stop_search", "parse_round_trip", "prune_superseded", "route_demand",
    "popular_pairs", "searches_per_hour_stream",
]
# Queries over request tables: reported as requests per second too.
REQUESTS = {"direct_departures": "events", "plan_stop_to_stop": "events", "plan_pins": "supplier",
            "two_leg_connections": "events", "connections_cascade": "events"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = every_query()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    times: dict[str, float] = {}
    t0 = time.time()
    t = load(spark, sf_dir)
    for table in ("schedule_stop", "schedule", "stop_time", "visit", "leg_geometry"):
        getattr(t, table)
    times["load_network"] = round(time.time() - t0, 3)
    for name in names:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    rates = {n: round(spark.read.parquet(f"{sf_dir}/{src}.parquet").count() / times[n], 1)
             for n, src in REQUESTS.items() if n in times}
    print(json.dumps({"metric": "total wall time of headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "requests_per_sec": rates,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
