"""Windows over groups of any size.

A plain window sorts each group in one task, which fails when one group holds a large
share of the rows. These helpers cut a group into blocks of consecutive positions, run
the window per block, and carry a one-row summary of each block across to the next. That
costs one more aggregation and a join of the summaries, whatever the size of the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def running(df: DataFrame, keys: Sequence[str], pos: str,
            specs: dict[str, tuple], block: int = BLOCK) -> DataFrame:
    """Running extremes along ``pos`` within ``keys``.

    ``specs`` maps an output name to (fn, column, side, inclusive): fn is "max" or
    "min", side is "before" or "after". Nulls are ignored, as in SQL windows.
    """
    keys = list(keys)
    cut = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)))
    agg = {"max": F.max, "min": F.min}
    pick = {"max": F.greatest, "min": F.least}

    local = Window.partitionBy(*keys, "_blk").orderBy(pos)
    across = Window.partitionBy(*keys).orderBy("_blk")
    lo, hi = Window.unboundedPreceding, Window.unboundedFollowing

    out = cut
    for name, (fn, col, side, incl) in specs.items():
        frame = (local.rowsBetween(lo, 0 if incl else -1) if side == "before"
                 else local.rowsBetween(0 if incl else 1, hi))
        out = out.withColumn(name, agg[fn](col).over(frame))

    sums = cut.groupBy(*keys, "_blk").agg(
        *[agg[fn](col).alias("_s_" + n) for n, (fn, col, _, _) in specs.items()])
    carried = sums.select(*keys, "_blk", *[
        agg[fn]("_s_" + n).over(
            across.rowsBetween(lo, -1) if side == "before" else across.rowsBetween(1, hi)
        ).alias("_c_" + n)
        for n, (fn, _, side, _) in specs.items()])
    some = None
    for n in specs:
        c = F.col("_c_" + n).isNotNull()
        some = c if some is None else some | c
    out = out.join(carried.filter(some), [*keys, "_blk"], "left")
    for name, (fn, _, _, _) in specs.items():
        out = out.withColumn(name, pick[fn](F.col(name), F.col("_c_" + name)))
    return out.drop("_blk", *["_c_" + n for n in specs])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
             bucket: Column, name: str) -> DataFrame:
    """``row_number() - 1`` within ``keys``; ``bucket`` must rise with ``order``.

    Each (keys, bucket) is numbered on its own and shifted by the count of the buckets
    before it.
    """
    keys = list(keys)
    cut = df.withColumn("_b", bucket)
    rn = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    sizes = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(*keys, "_b", before.alias("_off")).filter(F.col("_off").isNotNull())
    return (cut.withColumn("_rn", rn)
            .join(shift, [*keys, "_b"], "left")
            .withColumn(name, F.col("_rn") + F.coalesce(F.col("_off"), F.lit(0)))
            .drop("_b", "_rn", "_off"))


def surrogate_ids(df: DataFrame, key: str, start: Column, name: str) -> DataFrame:
    """Dense ids above ``start`` for rows with distinct ``key``, with no global sort.

    Rows fall into 65,536 buckets by a hash of the key; only the bucket counts meet in
    one place.
    """
    cut = df.withColumn("_b", F.conv(F.substring(F.md5(F.col(key)), 1, 4), 16, 10).cast("int"))
    sizes = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return (cut.withColumn("_rn", rn).join(shift, "_b")
            .withColumn(name, (start + F.col("_off") + F.col("_rn")).cast("bigint"))
            .drop("_b", "_rn", "_off"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in ``order`` (DISTINCT ON).

    Spark trims each input partition to its own first row before the shuffle.
    """
    return top_per(df, keys, order, 1).drop("_rank")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
            n: int) -> DataFrame:
    """The first ``n`` rows per key with their 1-based ``_rank``, trimmed map-side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
