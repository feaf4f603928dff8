"""A Merkle manifest of a dataset: levels kept as strings, one row for each block of a tree.

Every row is a leaf. Leaves are ordered within their group and numbered; ``arity ** height``
consecutive ones make an aligned block, whose level is one string of 64 hex digits a node. Each
fixed-width substring of ``arity`` nodes is hashed to the parent, the parents joined are the next
level, and what is left of a block is a node of the tree above, built the same way, until one
node stands for the group. Groups' nodes, in order, are the leaves of a last tree. A node's
siblings are the substrings to the left and right of it in its run, so a row's proof is cut out
of the levels of its block and of the few blocks above, and never shuffled.

A tree of any size is tables of bounded rows: a group with a third of all rows is as many blocks
as its rows need. Rows are numbered by counts of sorted ranges, not in one task.

Null values hash as ``-``, null groups come first. Rows of one group with equal keys (repeated
or null) are ordered by their leaf, so equal rows are told apart by place only. Texts of any
length, also empty ones, are hashed whole. One row alone is its own root, and its proof is
empty. An empty table gives no rows. Columns not named are not part of a leaf and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import in_order, once, record

HEX = 64
STEPS = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(columns: Sequence[Column]) -> Column:
    """The hash of a row's values, each with its length in bytes, so that none runs into the
    next; ``-`` stands for null."""
    return digest(F.concat(*(
        F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"),
                            c.cast("string")), F.lit("-")) for c in columns)))


def _parents(level: Column, arity: int) -> Column:
    """The next level: one hash for each run of ``arity`` nodes, the last maybe shorter."""
    width = HEX * arity
    runs = F.ceil(F.length(level) / F.lit(width)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda r: digest(
        level.substr(r * width + 1, F.lit(width)))), "").cast("binary")


def _levels(level: Column, total: Column, arity: int, height: int) -> Column:
    """All levels of a block. Only a block that is its whole tree may end before ``height``."""
    def up(levels, _):
        last = F.element_at(levels, -1)
        done = (F.length(last) == HEX) & (total <= arity ** height)
        return F.when(done, levels).otherwise(
            F.concat(levels, once(last, lambda x: F.array(_parents(x, arity)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(level), up)


def _steps(levels: Column, index: Column, arity: int) -> Column:
    """What flanks a node on its way up a block: (left, right) of its run at each level."""
    def step(depth):
        level = F.element_at(levels, depth)
        node = F.floor(index / F.pow(F.lit(float(arity)), depth - 1)).cast("int")
        own = node % arity
        return record(
            left=level.substr((node - own) * HEX + 1, own * HEX).cast("string"),
            right=level.substr((node + 1) * HEX + 1, (arity - 1 - own) * HEX).cast("string"))
    return F.when(F.size(levels) > 1, F.transform(
        F.sequence(F.lit(1), F.size(levels) - 1), step)).otherwise(
        F.array().cast(STEPS))


def _trees(nodes: DataFrame, arity: int, height: int, name: str) -> list[DataFrame]:
    """The blocks of all groups' trees, one table for each tier from the leaves up.

    ``nodes`` has (grp, pos, total, node) and may have a ``row`` to keep with each node.
    """
    size, tiers = arity ** height, []
    while True:
        index = (F.col("pos") % size).cast("int").alias("index")
        kept = ["node"] + ["row"] * ("row" in nodes.columns)
        blocks = (nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("block"))
                  .agg(F.array_sort(F.collect_list(F.struct(index, *kept))).alias("nodes"),
                       F.first("total").alias("total"))
                  .withColumn("levels", _levels(F.array_join("nodes.node", "").cast("binary"),
                                                F.col("total"), arity, height)))
        tiers.append(stored(blocks, f"{name}-{len(tiers)}"))
        nodes = tiers[-1].filter(F.col("total") > size).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"),
            _top(F.col("levels")).alias("node"))
        if nodes.isEmpty():
            return tiers


def _top(levels: Column) -> Column:
    return F.element_at(levels, -1).cast("string")


def _roots(tiers: list[DataFrame], size: int) -> DataFrame:
    """(grp, root): what remains of each group, from the tier where it is one block."""
    out = None
    for blocks in tiers:
        one = blocks.filter(F.col("total") <= size).select(
            "grp", _top(F.col("levels")).alias("root"))
        out = one if out is None else out.unionByName(one)
    return out


def _ways(blocks: DataFrame, arity: int) -> Column:
    """The nodes of a block, each with its steps to the top of the block."""
    names = blocks.schema["nodes"].dataType.elementType.names
    return F.transform("nodes", lambda x: record(
        **{n: x[n] for n in names}, steps=_steps(F.col("levels"), x["index"], arity)))


def _paths(tiers: list[DataFrame], above: DataFrame, size: int, arity: int,
           name: str) -> DataFrame:
    """(grp, index, node, row, steps) of the leaves: steps to the group's node, then ``above``.

    ``above`` has (grp, over), the steps from a group's node on. A block that is a whole tree
    goes on there, any other one where its node stands in the tier above.
    """
    below = None
    for tier in reversed(range(len(tiers))):
        blocks = tiers[tier]
        over = (blocks.filter(F.col("total") <= size).select("grp", "block")
                .join(above, "grp"))
        if below is not None:
            over = over.unionByName(below)
        # Steps are cut out before nodes become rows, so that no row carries the levels.
        each = (blocks.join(over, ["grp", "block"])
                .select("grp", "block", "over", F.explode(_ways(blocks, arity)).alias("x"))
                .select("grp", "block", "x.*", "over")
                .withColumn("steps", F.concat("steps", "over")))
        if tier == 0:
            return each.drop("block", "over")
        below = stored(each.select("grp", (F.col("block") * size + F.col("index"))
                                   .alias("block"), F.col("steps").alias("over")),
                       f"{name}-steps-{tier}")


def manifest(rows: DataFrame, group: Column, order: Column, node: Column,
             keep: dict[str, Column], arity: int = 2, height: int = 10) -> DataFrame:
    """One row for each row: ``keep``'s columns, leaf, subroot, root and ``steps``.

    ``node`` is a row's leaf hash (see ``leaf``). ``steps`` are (left, right) siblings from the
    leaf to the root; ``proof`` and ``fold`` read them. Groups are ordered by bytes, null first.
    """
    size = arity ** height
    grp = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    leaves = stored(rows.select(grp.alias("grp"), order.alias("key"), node.alias("node"),
                                F.struct(*(c.alias(n) for n, c in keep.items())).alias("row")),
                    "merkle-leaves")
    tiers = _trees(in_order(leaves, "grp", ["key", "node"], "merkle-ordered"), arity, height, "merkle")
    roots = stored(_roots(tiers, size), "merkle-subroots")
    tops = _trees(in_order(roots.select(F.lit("").alias("grp"), F.col("root").alias("node"),
                                        F.struct(F.col("grp").alias("of")).alias("row")),
                           "grp", ["row"], "merkle-groups"), arity, height, "merkle-top")
    end = _roots(tops, size).select("grp", "root")
    none = F.array().cast(STEPS)
    top = stored(_paths(tops, end.select("grp", none.alias("over")), size, arity, "merkle-top")
                 .join(end, "grp")
                 .select(F.col("row.of").alias("grp"), F.col("node").alias("subroot"), "root",
                         F.col("steps").alias("over")), "merkle-tops")
    found = _paths(tiers, top.select("grp", "over"), size, arity, "merkle")
    return (found.join(top.drop("over"), "grp")
            .select("row.*", F.col("node").alias("leaf"), "subroot", "root", "steps"))


def proof(steps: Column) -> Column:
    """The siblings, level by level and left to right, as one string."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf gives with these siblings."""
    return F.aggregate(steps, node, lambda x, s: digest(F.concat(s["left"], x, s["right"])))
