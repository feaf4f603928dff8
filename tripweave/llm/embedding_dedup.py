"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one on each half of the vectors, form a product grid; a vector lives in the
cell of its two nearest codewords. A search visits cells in the order of the sum of two
sorted sequences (how far the query is from leaving its own codeword's region towards another,
squared, in each half) until the sum passes what the target recall needs; what it finds is
verified by cosine in double precision.

With threshold c, vectors of length 1 that are linked are at most r = sqrt(2 - 2c) apart. A
neighbour in another cell is across a bisecting plane in one half or both, so the squared
distances to those planes add up to r^2 at most: going to r^2 loses nothing. For a
displacement in a random direction of d dimensions, r^2 (1 - (1 - recall)^(2 / (d - 2))) finds
that share of the farthest neighbours; ``recall=1`` visits all.

Equal vectors are one; they meet in their class and are never paired. Classes are compared in
blocks of a cell; a task gives back sums of links and a forest of the links it found. Codebooks
are fitted on ``sample`` vectors (a bound on what the driver holds); every row is indexed.

Rows with a null label, a null vector, null or non-finite components, no components or only
zeros link with nothing and stay. Vectors of different lengths never link. Null ids count only
where a component has no other. Repeated ids are separate vectors. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .links import components, forest
from .shared import ROW, number_of_blocks, with_rows

BLOCK = 2048
CLASS = ["label", "v1", "v2"]


def _unit(column) -> np.ndarray:
    """Rows of a list column as vectors of length 1, all of one length."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = v.reshape(len(flat), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _centres(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for i in range(len(c)):
            if (own := near == i).any():
                c[i] = x[own].mean(0)
    return c


class Grid:
    """The codebooks of the two halves, and which cells a search visits."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [_centres(sample[:, :self.half], k), _centres(sample[:, self.half:], k)]
        self.width = max(map(len, self.books))

    def gaps(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(home cell, squared distance to leaving it towards each codeword, by half)."""
        home, out = np.zeros(len(x), np.int64), []
        for book, part in zip(self.books, (x[:, :self.half], x[:, self.half:])):
            d = (part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T
            own = d.argmin(1)
            apart = np.sqrt(((book[own][:, None] - book) ** 2).sum(2))
            lead = d - d[np.arange(len(x)), own][:, None]
            out.append((np.maximum(lead, 0) / np.where(apart > 0, 2 * apart, np.inf)) ** 2)
            home = home * self.width + own
        return home, out

    def visits(self, x: np.ndarray, bound: float):
        """(home cells, row of each visit, cell of each visit), nearest cells first."""
        home, (first, second) = self.gaps(x)
        rows, cells = [], []
        order = np.argsort(second, 1)
        ranked = np.take_along_axis(second, order, 1)
        for i in range(first.shape[1]):
            # With codeword i in the first half, as far along the second half as allowed.
            ok = first[:, i, None] + ranked <= bound + 1e-9
            r, c = np.nonzero(ok)
            rows.append(r)
            cells.append(i * self.width + order[r, c])
        return home, np.concatenate(rows), np.concatenate(cells)


def usable(vec, label):
    """Whether a row can link at all."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def search_bound(threshold: float, recall: float, dims: int) -> float:
    """The sum of squared plane distances up to which cells are visited."""
    share = 1.0 if recall >= 1 or dims < 3 else 1 - (1 - recall) ** (2 / (dims - 2))
    return max(0.0, 2 - 2 * threshold) * share


def near_duplicates(rows: DataFrame, threshold: float = 0.98, recall: float = 0.9999,
                    k: int = 32, sample: int = 20_000, block: int = BLOCK,
                    vec: str = "embedding", label: str = "label",
                    key: str = "vec_id") -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    v = F.col(vec)
    all_rows = with_rows(rows.select(F.col(key).alias("key"), v.alias("vec"),
                                     F.col(label).alias("label"))
                         .withColumn("fit", usable(F.col("vec"), F.col("label")))
                         .withColumn("v1", F.xxhash64("vec", F.lit(1)))
                         .withColumn("v2", F.xxhash64("vec", F.lit(2))), "vectors")
    classes = stored(all_rows.filter("fit").groupBy(*CLASS)
                     .agg(F.min(ROW).alias("id"), F.count(F.lit(1)).alias("copies"),
                          F.min("key").alias("least_key"), F.first("vec").alias("vec"))
                     .withColumn("dims", F.size("vec")), "vector-classes")
    grids = {}
    for d in [r[0] for r in classes.select("dims").distinct().collect()]:
        drawn = (classes.filter(F.col("dims") == d).orderBy(F.xxhash64("id")).limit(sample)
                 .select("vec").toArrow())
        grids[d] = Grid(_unit(drawn.column("vec")), k)
    bounds = {d: search_bound(threshold, recall, d) for d in grids}

    def place(batches):
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                for part in (b.filter(pa.array(dims == d)),):
                    for at in range(0, part.num_rows, 1000):
                        some = part.slice(at, 1000)
                        home, row, cell = grids[d].visits(_unit(some.column("vec")), bounds[d])
                        row = np.concatenate((np.arange(len(home)), row))
                        side = np.repeat(np.array([0, 1], np.int32),
                                         [len(home), len(row) - len(home)])
                        cell = np.concatenate((home, cell))
                        take = some.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays(
                            [*(take.column(c) for c in ("label", "dims", "id", "copies", "vec")),
                             pa.array(cell), pa.array(side)],
                            ["label", "dims", "id", "copies", "vec", "cell", "side"])

    kind = dict(classes.dtypes)
    placed = classes.select("label", "dims", "id", "copies", "vec").mapInArrow(
        place, f"label {kind['label']}, dims int, id long, copies long, vec {kind['vec']}, "
               "cell long, side int")
    bucket = ["label", "dims", "cell"]
    sizes = (placed.groupBy(*bucket).agg(F.count_if(F.col("side") == 0).alias("homes"),
                                         F.count_if(F.col("side") == 1).alias("asks"))
             .filter("homes > 0 and asks > 1"))
    sizes = stored(sizes.select(*bucket, number_of_blocks(F.col("homes"), block).alias("nh"),
                                number_of_blocks(F.col("asks"), block).alias("na")), "cells")
    home = F.col("side") == 0
    mine = F.pmod(F.xxhash64("id"), F.when(home, F.col("nh")).otherwise(F.col("na"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(home, F.col("na")).otherwise(F.col("nh")) - 1))
    spread = (placed.join(sizes, bucket).withColumn("mine", mine).withColumn("other", other)
              .withColumn("bh", F.when(home, F.col("mine")).otherwise(F.col("other")))
              .withColumn("ba", F.when(home, F.col("other")).otherwise(F.col("mine")))
              .drop("mine", "other", "nh", "na"))

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        homes, asks = (group.filter(pa.array(side == s)) for s in (0, 1))
        none = np.zeros(0, np.int64)
        hid, aid = homes.column("id").to_numpy(), asks.column("id").to_numpy()
        n_home, n_ask = np.zeros(len(hid), np.int64), np.zeros(len(aid), np.int64)
        found = [(none, none)]
        if len(hid) and len(aid):
            d = group.column("dims")[0].as_py()
            grid, bound = grids[d], bounds[d]
            x, y = _unit(homes.column("vec")), _unit(asks.column("vec"))
            hn, an = homes.column("copies").to_numpy(), asks.column("copies").to_numpy()
            cells, (first, second) = grid.gaps(y)[0], grid.gaps(x)[1]
            for k in range(0, len(y), 256):
                some = slice(k, k + 256)
                near = (x @ y[some].T >= threshold) & (hid[:, None] != aid[some])
                n_ask[some] += hn @ near
                # The other way is counted here only if that search doesn't come this way.
                c = cells[some]
                comes = first[:, c // grid.width] + second[:, c % grid.width] <= bound + 1e-9
                n_home += (near & ~comes) @ an[some]
                i, j = np.nonzero(near)
                found.append(forest(aid[some][j], hid[i]))
        a, b = forest(*(np.concatenate(c) for c in zip(*found)))
        ids, n = np.concatenate((hid, aid)), np.concatenate((n_home, n_ask))
        ids, n = ids[n > 0], n[n > 0]
        return pa.table({"counts": pa.array(np.repeat([False, True], [len(a), len(ids)])),
                         "a": pa.array(np.concatenate((a, ids)), pa.int64()),
                         "b": pa.array(np.concatenate((b, n)), pa.int64())})

    made = stored(spread.groupBy(*bucket, "bh", "ba")
                  .applyInArrow(compare, "counts boolean, a long, b long"), "vector-links")
    links = made.filter("counts").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    roots = components(made.filter("not counts").select("a", "b"), "vector-components")
    owned = (classes.select(*CLASS, "id", "copies", "least_key")
             .join(links, "id", "left").join(roots, "id", "left")
             .withColumn("root", F.coalesce("root", "id"))
             .withColumn("n", F.coalesce("links", F.lit(0)) + F.col("copies") - 1))
    least = owned.groupBy("root").agg(F.min("least_key").alias("component"))
    named = stored(owned.join(least, "root").select(*CLASS, "n", "component"), "vector-named")
    linked = (all_rows.filter("fit").select("key", *CLASS).join(named, CLASS)
              .select("key", F.col("n").alias("n_links"), F.col("component").alias("component_id")))
    alone = all_rows.filter("not fit").select("key", F.lit(0).cast("long").alias("n_links"),
                                              F.col("key").alias("component_id"))
    return (linked.unionByName(alone)
            .withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
            .withColumnRenamed("key", key))
