"""Sharding: best-fit decreasing bin packing of groups of equal texts into shards.

Copies of a text stay together. Groups go, largest first, into the shard with the least room
that still takes them; a balanced tree over the rooms left finds it in logarithmic time. Where
none has room, the group goes where most is left.

Groups are packed in rooms of ``room_rows`` (more for over 781 shards: 64 rows a shard), dealt
at random. Groups of at least a
``room_rows``-th of all bytes (so fewer than ``room_rows`` by their number) are packed first, all
in one room; every other room then fills its part of what these leave in each shard. Within a
room equal rooms left are taken from another shard on, so that what rooms overrun does not add
up in the same shards. A shard's bytes differ from the mean by little more than its last, small
groups of each room.

The capacity is the least at which the bytes can fit: the mean, once texts over it, which can't
be divided, have shards of their own. Copies that take more than a whole shard are cut into as
few parts as possible, each of whole rows. With ``capacity`` given instead of ``shards``, the
fewest shards are found whose packing keeps to it; a text over it is an error.

Null texts have no bytes and are the same group as empty ones. Each row counts ``overhead``
bytes. Groups of equal size go by the hash of their text, rows of a group are never told apart
by their ids, so null and repeated ids do no harm. Texts of any length are read whole, once. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import numbered
from ..session import stored
from .shared import ROW, in_order, whole, with_rows

ROOM_ROWS = 50_000
ROOM_PER_SHARD = 64
GROUP = ["h1", "h2"]
SPAN = 1 << 16


class Rooms:
    """A balanced (AVL) tree of shards by (room left, rank); ranks settle equal rooms."""

    def __init__(self, rooms: list[int]):
        self.key = [(room, i) for i, room in enumerate(rooms)]
        n = len(rooms)
        self.left, self.right, self.height = [-1] * n, [-1] * n, [1] * n
        self.root = self._built(sorted(range(n), key=self.key.__getitem__))

    def _built(self, order: list[int]) -> int:
        if not order:
            return -1
        mid = len(order) // 2
        return self._joined(self._built(order[:mid]), order[mid], self._built(order[mid + 1:]))

    def _tall(self, i: int) -> int:
        return self.height[i] if i >= 0 else 0

    def _joined(self, left: int, i: int, right: int) -> int:
        self.left[i], self.right[i] = left, right
        self.height[i] = 1 + max(self._tall(left), self._tall(right))
        return i

    def _even(self, i: int) -> int:
        """The subtree of ``i``, turned so that its sides differ by one level at most."""
        lo, hi = self.left[i], self.right[i]
        if self._tall(lo) > self._tall(hi) + 1:
            if self._tall(self.right[lo]) > self._tall(self.left[lo]):
                lo = self._turned_left(lo)
            return self._turned_right(self._joined(lo, i, hi))
        if self._tall(hi) > self._tall(lo) + 1:
            if self._tall(self.left[hi]) > self._tall(self.right[hi]):
                hi = self._turned_right(hi)
            return self._turned_left(self._joined(lo, i, hi))
        return self._joined(lo, i, hi)

    def _turned_left(self, i: int) -> int:
        up = self.right[i]
        return self._joined(self._joined(self.left[i], i, self.left[up]), up, self.right[up])

    def _turned_right(self, i: int) -> int:
        up = self.left[i]
        return self._joined(self.left[up], up, self._joined(self.right[up], i, self.right[i]))

    def _with(self, at: int, i: int) -> int:
        if at < 0:
            return self._joined(-1, i, -1)
        if self.key[i] < self.key[at]:
            return self._even(self._joined(self._with(self.left[at], i), at, self.right[at]))
        return self._even(self._joined(self.left[at], at, self._with(self.right[at], i)))

    def _without(self, at: int, i: int) -> int:
        if at != i:
            if self.key[i] < self.key[at]:
                return self._even(self._joined(self._without(self.left[at], i), at,
                                               self.right[at]))
            return self._even(self._joined(self.left[at], at, self._without(self.right[at], i)))
        if self.left[at] < 0 or self.right[at] < 0:
            return max(self.left[at], self.right[at])
        heir = self.right[at]
        while self.left[heir] >= 0:
            heir = self.left[heir]
        rest = self._without(self.right[at], heir)
        return self._even(self._joined(self.left[at], heir, rest))

    def fitting(self, size: int) -> int:
        """The shard with the least room of at least ``size``; else the one with most."""
        at, best = self.root, -1
        while at >= 0:
            if self.key[at][0] >= size:
                at, best = self.left[at], at
            else:
                at = self.right[at]
        if best < 0:
            best = self.root
            while self.right[best] >= 0:
                best = self.right[best]
        return best

    def take(self, i: int, size: int) -> None:
        self.root = self._without(self.root, i)
        self.key[i] = (self.key[i][0] - size, i)
        self.root = self._with(self.root, i)


def even_capacity(sizes: list[int], total: int, shards: int) -> int:
    """The mean of ``total``, once the sizes over it (given largest first) are set aside."""
    for size in sizes:
        if shards < 2 or size * shards <= total:
            break
        total, shards = total - size, shards - 1
    return -(-total // shards)


def best_fit(sizes: list[int], rooms: list[int]) -> np.ndarray:
    """The shard of each size, taken in the order given."""
    tree, out = Rooms(rooms), np.empty(len(sizes), np.int64)
    for n, size in enumerate(sizes):
        out[n] = at = tree.fitting(size)
        tree.take(at, size)
    return out


def _sized(docs: DataFrame, overhead: int, text: str, key: str) -> DataFrame:
    """(key, size, text_crc32, h1, h2, row) of every document, written down."""
    t = whole(F.col(text))
    return with_rows(docs.select(
        F.col(key).alias("key"), (F.octet_length(t) + F.lit(overhead).cast("long")).alias("size"),
        F.crc32(t).alias("text_crc32"), F.xxhash64(t, F.lit(1)).alias("h1"),
        F.xxhash64(t, F.lit(2)).alias("h2")), "shard-sizes")


def _cut(rows: DataFrame, groups: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Groups over ``capacity`` cut into parts of whole rows; rows and groups with ``part``.

    There are fewer such groups than shards, each cut by the number of its row.
    """
    most = F.greatest(F.lit(1), F.floor(F.lit(capacity) / F.col("size"))).cast("long")
    large = stored(groups.filter((F.col("bytes") > capacity) & (F.col("copies") > 1))
                   .withColumn("most", most), "shard-large")
    ranks = numbered(rows.join(large.select(*GROUP, "most"), GROUP), GROUP, [ROW],
                     F.floor(F.col(ROW) / SPAN), "rank")
    rows = stored(ranks.withColumn("part", F.floor(F.col("rank") / F.col("most")))
                  .drop("rank", "most").unionByName(
        rows.join(large.select(*GROUP), GROUP, "left_anti")
        .withColumn("part", F.lit(0).cast("long"))), "shard-rows")
    parts = large.withColumn("part", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("copies") / F.col("most")) - 1)))
    parts = parts.withColumn("copies", F.least("most", F.col("copies")
                                               - F.col("part") * F.col("most")))
    parts = parts.withColumn("bytes", F.col("copies") * F.col("size")).drop("most")
    uncut = groups.join(large.select(*GROUP), GROUP, "left_anti")
    return rows, stored(parts.unionByName(uncut.withColumn("part", F.lit(0).cast("long"))),
                        "shard-groups")


def _packed(groups: DataFrame, rooms: list[int], room_rows: int) -> DataFrame:
    """Groups with their ``shard``: the large ones first, the others room by room."""
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    kinds = "h1 long, h2 long, part long, copies long, shard int"
    names = ["h1", "h2", "part", "copies"]
    large = F.col("bytes") * room_rows >= total
    many = -(-n // room_rows)

    def fit(group: pa.Table, rooms: list[int], turn: int) -> pa.Table:
        size, h1, h2 = (group.column(c).to_numpy() for c in ("bytes", "h1", "h2"))
        order = np.lexsort((group.column("part").to_numpy(), h2, h1, -size))
        turned = np.roll(np.arange(len(rooms)), -turn)
        shard = turned[best_fit(size[order].tolist(), [rooms[i] for i in turned])]
        return (group.select(names).take(order)
                .append_column("shard", pa.array(shard, pa.int32())))

    def part(rooms: list[int], rest: int):
        def fill(group: pa.Table) -> pa.Table:
            mine = int(group.column("bytes").to_numpy().sum())
            turn = group.column("room")[0].as_py()
            left = [max(0, r) for r in rooms]
            own = [-(-r * mine // max(1, sum(left))) for r in left] if rest else left
            return fit(group, own, turn % len(rooms))
        return fill

    columns = [*names, "bytes"]
    if many <= 1:
        one = groups.select(*columns).withColumn("room", F.lit(0))
        return one.groupBy("room").applyInArrow(lambda g: fit(g, rooms, 0), kinds)
    first = stored(groups.filter(large).select(*columns).withColumn("room", F.lit(0))
                   .groupBy("room").applyInArrow(lambda g: fit(g, rooms, 0), kinds),
                   "shard-first")
    sizes = groups.select("h1", "h2", "part", "bytes")
    used = {r[0]: r[1] for r in first.join(sizes, ["h1", "h2", "part"]).groupBy("shard")
            .agg(F.sum("bytes")).collect()}
    left = [room - used.get(i, 0) for i, room in enumerate(rooms)]
    room = F.pmod(F.xxhash64("h1", "h2", "part"), F.lit(many)).cast("int")
    others = (groups.filter(~large).select(*columns).withColumn("room", room)
              .groupBy("room").applyInArrow(part(left, total), kinds))
    return first.unionByName(others)


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None,
          overhead: int = 16, text: str = "text", key: str = "doc_id",
          room_rows: int = ROOM_ROWS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every document; slots count from 0 in a
    shard, by key, null keys first.

    Give either the number of shards or the bytes one shard may hold.
    """
    rows = _sized(docs, overhead, text, key)
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    groups = stored(rows.groupBy(*GROUP).agg(
        F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"),
        F.sum("size").alias("bytes")), "shard-copies")
    total, longest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)),
                              F.coalesce(F.max("size"), F.lit(0))).first()
    if capacity is not None and longest > capacity:
        raise ValueError(f"a document of {longest} bytes is over the capacity of {capacity}")
    n = shards or max(1, -(-total // capacity))
    while True:
        # Fewer than n documents can be over the mean.
        over_mean = (rows.filter(F.col("size") * n > total).orderBy(F.desc("size")).limit(n)
                     .select("size").collect())
        most = capacity or max(1, even_capacity([r[0] for r in over_mean], total, n))
        cut_rows, parts = _cut(rows, groups, most)
        packed = stored(_packed(parts, [most] * n, max(room_rows, ROOM_PER_SHARD * n)),
                        "shard-packed")
        if shards:
            break
        over = (packed.join(parts.select(*GROUP, "part", "bytes"), [*GROUP, "part"])
                .groupBy("shard").agg(F.sum("bytes").alias("b")).filter(F.col("b") > capacity))
        if over.isEmpty():
            break
        n += max(1, n // 100)
    placed = cut_rows.join(packed.select(*GROUP, "part", "shard"), [*GROUP, "part"])
    slots = in_order(placed.select("key", "size", "text_crc32", "shard", ROW), "shard",
                     ["key", ROW], "shard-slots")
    return slots.select(F.col("key").alias(key), "size", "text_crc32", "shard",
                        F.col("pos").alias("slot"))
