"""Plan queries on tables of their own."""

from __future__ import annotations

from tripweave.plans import every_query


def test_plan_mixed_plans_searches_without_options(spark, tmp_path):
    """A search that showed no option is planned like one that did."""
    def table(name, rows, columns):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")

    table("part", [(i, "p") for i in range(100)], "p_partkey long, p_name string")
    table("supplier", [(0,)], "s_suppkey long")
    table("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    table("region", [(0, "R")], "r_regionkey int, r_name string")
    table("customer", [(1, 0, 1.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    table("orders", [(4, 1, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string")
    # User 1 starts at stop 8; events 1 and 51 ask for stop 5.
    table("lineitem", [(4, 8, 1), (4, 9, 2), (4, 5, 3)], "l_orderkey long, l_partkey long, l_linenumber int")
    table("events", [(1, "search", 1, '{"k": 0}', 1.0, "2026-01-01 00:00:00"),
                     (51, "search", 1, '{"k": 1}', 1.0, "2026-01-01 00:00:00")],
          "event_id long, event_type string, user_id long, props string, value double, ts string")
    rows = every_query()[0]["plan_mixed"](spark, str(tmp_path)).collect()
    got = {r["request_id"]: (r["schedule_id"], r["from_seq"], r["to_seq"]) for r in rows}
    assert got == {1: (4, 0, 2), 51: (4, 0, 2)}
