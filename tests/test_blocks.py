"""Blocked windows against plain ones, with blocks far smaller than the groups."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripweave.operators.blocks import numbered, running, surrogate_ids


def _rows(spark):
    # One key holds most rows.
    return spark.range(500).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") * 3).alias("pos"),
        F.when(F.col("id") % 3 != 0, F.hash("id") % 100).alias("v"))


def test_running_matches_windows(spark):
    df = _rows(spark)
    w = W.partitionBy("k").orderBy("pos")
    want = df.select("k", "pos", F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("a"),
                     F.min("v").over(w.rowsBetween(1, W.unboundedFollowing)).alias("b"),
                     F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("c"))
    got = running(df, ["k"], "pos", {"a": ("max", "v", "before", False), "b": ("min", "v", "after", False),
                                     "c": ("max", "v", "before", True)}, block=16).select("k", "pos", "a", "b", "c")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_numbered_matches_row_number(spark):
    df = _rows(spark)
    want = df.select("k", "pos", (F.row_number().over(W.partitionBy("k").orderBy("pos")) - 1).alias("n"))
    got = numbered(df, ["k"], ["pos"], F.floor(F.col("pos") / 32), "n").select("k", "pos", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_surrogate_ids_are_dense_and_stable(spark):
    df = spark.range(300).select(F.concat(F.lit("stop "), "id").alias("name"))
    a = {r["name"]: r["id"] for r in surrogate_ids(df, "name", F.lit(1000), "id").collect()}
    b = {r["name"]: r["id"] for r in surrogate_ids(df.repartition(5), "name", F.lit(1000), "id").collect()}
    assert a == b and sorted(a.values()) == list(range(1001, 1301))
