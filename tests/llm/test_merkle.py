"""The manifest against trees built node by node."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tripweave.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes, arity):
    """(root, for each node what stands left and right of it on its way up)."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for n, i in enumerate(at):
            s = i - i % arity
            ways[n].append("".join(level[s:i]) + "".join(level[i + 1:s + arity]))
            at[n] = i // arity
        level = [h("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
    return level[0], ways


def brute(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for g, key, val in rows:
        groups.setdefault(g, []).append((key is not None, key or 0, h(field(key) + field(val))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])], arity) for g in order]
    root, ups = tree([t[0] for t in trees], arity) if trees else (None, [])
    return sorted(((key if has else None, leaf, sub, root, "".join(way + up))
                   for g, (sub, ways), up in zip(order, trees, ups)
                   for (has, key, leaf), way in zip(sorted(groups[g]), ways)), key=str)


@pytest.mark.parametrize("n, arity, height", [(0, 2, 1), (1, 2, 2), (70, 3, 1), (150, 2, 2),
                                              (150, 2, 10)])
def test_equals_trees_built_node_by_node(spark, n, arity, height):
    rnd = random.Random(n + arity)
    rows = [(rnd.choice(["a", "b", "b", "b", None, "é", ""]), rnd.choice([None, *range(60)]),
             rnd.choice(["x", "yy", None, "", "é" * 5000])) for _ in range(n)]
    # A column called like the operator's own does no harm.
    df = spark.createDataFrame([(*r, "z") for r in rows], "g string, key long, val string, steps string")
    got = merkle.manifest(df, F.col("g"), F.col("key"), merkle.leaf([F.col("key"), F.col("val")]),
                          {"key": F.col("key")}, arity, height)
    got = got.withColumn("way", merkle.proof(F.col("steps"))).withColumn(
        "again", merkle.fold(F.col("leaf"), F.col("steps")))
    rows_got = [(r.key, r.leaf, r.subroot, r.root, r.way) for r in got.collect()]
    assert sorted(rows_got, key=str) == brute(rows, arity)
    assert got.filter("again != root").isEmpty()


def test_a_changed_row_does_not_fold_to_the_root(spark):
    df = spark.range(9).select(F.lit("g").alias("g"), F.col("id").alias("key"))
    leaf, other = merkle.leaf([F.col("key")]), merkle.leaf([F.col("key") + 1])
    got = merkle.manifest(df, F.col("g"), F.col("key"), leaf, {"other": other}, 2, 2)
    assert got.filter(merkle.fold(F.col("other"), F.col("steps")) == F.col("root")).isEmpty()


def test_values_never_run_into_each_other(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None)], "a string, b string")
    assert df.select(merkle.leaf([F.col("a"), F.col("b")])).distinct().count() == 4
