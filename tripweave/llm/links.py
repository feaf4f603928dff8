"""Links between rows of a bucket, and what is connected by links.

Buckets of any size are cut into blocks; a task compares one block with another and gives
back only what it found, so a bucket that holds a third of all rows is many small tasks.
Components are found by alternating star operations on tables of links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import ROW, number_of_blocks


def block_pairs(rows: DataFrame, bucket: list[str], most: int, name: str) -> DataFrame:
    """``rows`` once for each pair of blocks of its bucket that it takes part in.

    Adds ``bi`` and ``bj``, the blocks compared (bi <= bj), and ``side``: 0 for a row of
    block bi, 1 for one of bj; in a block's comparison with itself a row comes once, as 0.
    ``rows`` needs a ``__row`` id; buckets of one row give nothing.
    """
    sizes = stored(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"))
                   .filter("size > 1").withColumn("blocks", number_of_blocks(F.col("size"), most))
                   .drop("size"), name)
    mine = F.pmod(F.xxhash64(F.col(ROW)), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    return (rows.join(sizes, bucket).withColumn("mine", mine)
            .withColumn("other", F.explode(others))
            .withColumn("bi", F.least("mine", "other"))
            .withColumn("bj", F.greatest("mine", "other"))
            .withColumn("side", (F.col("mine") != F.col("bi")).cast("int"))
            .drop("blocks", "mine", "other"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same ids as links (a, b): each id to the least of its own."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def linked_blocks(pairs: DataFrame, bucket: list[str], payload: list[str],
                  compare: Callable) -> DataFrame:
    """(a, b): links within each pair of blocks, thinned to a forest.

    ``compare(left, right)`` gets the payload columns of two blocks as Arrow tables (the same
    table twice for a block with itself) and gives index arrays of linked rows.
    """
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        left = group.filter(pa.array(side == 0))
        right = group.filter(pa.array(side == 1)) if (side == 1).any() else left
        i, j = compare(left, right)
        a, b = left.column(ROW).to_numpy()[i], right.column(ROW).to_numpy()[j]
        a, b = forest(a[a != b], b[a != b])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (pairs.select(*bucket, "bi", "bj", "side", ROW, *payload)
            .groupBy(*bucket, "bi", "bj").applyInArrow(run, "a long, b long"))


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, root): the least id each id reaches over ``links`` (a, b); only linked ids.

    Alternates large stars (larger neighbours go to the least neighbour) and small stars
    (smaller neighbours and the id itself do) until nothing changes, in a number of rounds
    that grows with the logarithm of the longest chain. Each round writes its links to the
    shared folder. Least neighbours are aggregated before any row is shuffled, and written
    down, so that the join with a hub's links can be split.
    """
    def least(edges, table):
        return stored(edges.groupBy("u").agg(F.min("v").alias("m")), table)

    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = stored(links.filter("a != b").select(hi.alias("u"), lo.alias("v")).distinct(), name)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both, f"{name}-large").withColumn("m", F.least("m", "u"))
        large = stored(both.filter("v > u").join(m, "u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .filter("u != v").distinct(), name)
        m = least(large, f"{name}-small")
        small = (large.join(m, "u").filter("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(m.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        now = stored(small, name)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                        F.count_distinct("u")).first()
        # Done when nothing changes; stars alone have one link for each id that is no root.
        if before == state or state[0] == 0:
            break
        before = state
    roots = now.select(F.col("v").alias("id")).distinct()
    return stored(now.select(F.col("u").alias("id"), F.col("v").alias("root"))
                  .union(roots.select("id", F.col("id").alias("root"))), f"{name}-roots")
