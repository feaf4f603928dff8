"""Hard negatives by exact search over lists shared by clusters of anchors.

Anchors are clustered by direction. For a whole cluster the candidates are sorted once by a bound
on their inner product with any member: |c| cos(max(0, angle of c to the centre - widest angle of
a member)), times the member's own length. Every member walks that list from the top and keeps
the best rows it still needs; it ends when the bound of what follows is below the last of them,
which certifies that nothing better is left. The list's head goes first and what it gives is
where the walk of the rest may end, so candidates below what every member needs are never sent.

A walk happens first among rows of the anchor's own label (its positives), then among the others,
for the best whose score lies in a band below each positive's.

Members and lists are cut into blocks; a block of members walks a block of a list in one task, so
a cluster, label or vector that holds a third of all rows is many tasks. Centres, and where a
list's head ends, come from ``sample`` vectors (a bound on what the driver holds); both decide
how much is read, never what is found.

Labels and ids are whole numbers. Rows with a null label, a null vector or null or non-finite
components take no part. Vectors meet those with as many components only. Equal scores go by id,
null ids last, then by row, so repeated rows and repeated ids are told apart; a null id is no
anchor. Zero vectors score 0. Scores are whole numbers, exact up to 2^53. An empty table, one
without anchors, or an anchor with no positives gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import top_per
from ..session import stored
from .shared import ROW, with_rows

MEMBERS = 1024
LISTED = 8192
STEP = 512
NO_ID = (1 << 63) - 1
#: Bounds are worked out in doubles; this share is added before anything is passed over.
SLACK = 1e-9


def usable(vec: Column, label: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine, F.lit(False))


def _matrix(column, steps: float) -> np.ndarray:
    """Rows of a list column of equal lengths, each component rounded down to whole steps."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(v.reshape(len(flat), len(v) // max(1, len(flat))) * steps)


def _directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, vectors of length 1; zero vectors stay)."""
    most = np.abs(v).max(1, initial=0)
    scaled = v / np.where(most > 0, most, 1)[:, None]
    length = np.sqrt((scaled * scaled).sum(1))
    return length * most, scaled / np.where(length > 0, length, 1)[:, None]


def _angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centres.T, -1, 1))


class Clusters:
    """Centres of the anchors' directions, and the lists' bounds."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 10):
        v = _directions(sample)[1]
        rng = np.random.default_rng(11)
        self.centres = v[rng.choice(len(v), min(k, len(v)), replace=False)]
        for _ in range(rounds):
            own = (v @ self.centres.T).argmax(1)
            for i in range(len(self.centres)):
                if (mine := own == i).any():
                    self.centres[i] = _directions(v[mine].sum(0)[None])[1][0]
        self.radius = np.zeros(len(self.centres))
        self.head = np.zeros(len(self.centres))

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, angle to its centre, length) of each row."""
        length, unit = _directions(v)
        angles = _angles(unit, self.centres)
        own = angles.argmin(1)
        return own, angles[np.arange(len(v)), own], length

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """By row and cluster: at least the inner product with any direction of a member."""
        length, unit = _directions(v)
        gap = np.maximum(0, _angles(unit, self.centres) - self.radius - 1e-7)
        cos = np.cos(gap)
        return length[:, None] * (cos + SLACK)


def _best(query, score, order, row, most: int) -> np.ndarray:
    """Places of the first ``most`` of each query: higher scores, then smaller ids, then rows."""
    at = np.lexsort((row, order, -score, query))
    q = query[at]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return at[rank < most]


def walk(members: dict, listed: dict, same: bool, most: int) -> dict:
    """What each query of each member takes from a list in falling order of bound.

    A member has one query for each column of ``cap`` and ``need``: the best ``most`` rows
    with scores from ``need`` to ``cap``; a need that is infinite asks for nothing.
    """
    slots = members["cap"].shape[1]
    need, length = members["need"].copy(), members["length"]
    found = {n: np.zeros(0, t) for n, t in (("query", np.int64), ("score", np.float64),
                                            ("order", np.int64), ("row", np.int64))}
    # Every slot of a member ends by itself; a member goes on while any of its slots does.
    for at in range(0, len(listed["row"]), STEP):
        part = slice(at, at + STEP)
        ceiling = length * listed["bound"][at] + SLACK * np.abs(length * listed["bound"][at])
        on = np.flatnonzero((ceiling[:, None] >= need).any(1))
        if not len(on):
            break
        score = members["vec"][on] @ listed["vec"][part].T
        alike = members["label"][on][:, None] == listed["label"][part]
        fits = (alike if same else ~alike) & (
            members["row"][on][:, None] != listed["row"][part])
        got = [found]
        for s in range(slots):
            i, j = np.nonzero(fits & (score <= members["cap"][on, s][:, None])
                              & (score >= need[on, s][:, None]))
            got.append({"query": on[i] * slots + s, "score": score[i, j],
                        "order": listed["order"][part][j], "row": listed["row"][part][j]})
        every = {n: np.concatenate([g[n] for g in got]) for n in found}
        keep = _best(every["query"], every["score"], every["order"], every["row"], most)
        found = {n: c[keep] for n, c in every.items()}
        # A full query needs its last row's score from now on.
        query, first = np.unique(found["query"], return_index=True)
        full = np.diff(np.r_[first, len(found["query"])]) == most
        last = found["score"][(np.r_[first, len(found["query"])][1:] - 1)[full]]
        q = query[full]
        need[q // slots, q % slots] = np.maximum(need[q // slots, q % slots], last)
    return found


class Search:
    """The anchors of a table, clustered, and the walks over its lists."""

    def __init__(self, rows: DataFrame, steps: float, clusters: int, sample: int, head: float,
                 members: int, listed: int):
        self.rows, self.steps, self.listed = rows, steps, listed
        self.models: dict[int, Clusters] = {}
        self.blocks: dict[tuple[int, int], int] = {}
        kind = dict(rows.dtypes)
        self.vec = kind["vec"]
        counts = rows.groupBy("dims").agg(F.count(F.lit(1)), F.count_if("anchor")).collect()
        self.lists = {d: max(1, -(-n // listed)) for d, n, a in counts if a}
        for d in self.lists:
            mine = rows.filter((F.col("dims") == d) & F.col("anchor"))
            self.models[d] = Clusters(_matrix(self._drawn(mine, sample), steps), clusters)
        self.anchors = stored(self._clustered(), "anchors")
        about = self.anchors.groupBy("dims", "cluster").agg(F.count(F.lit(1)), F.max("angle"))
        for d, c, n, angle in about.collect():
            self.blocks[d, c] = max(1, -(-n // members))
            self.models[d].radius[c] = angle
        for d, model in self.models.items():
            drawn = _matrix(self._drawn(rows.filter(F.col("dims") == d), sample), steps)
            model.head = np.quantile(model.bounds(drawn), 1 - head, axis=0)

    def _drawn(self, rows: DataFrame, sample: int):
        return (rows.orderBy(F.xxhash64(ROW)).limit(sample).select("vec").toArrow()
                .column("vec"))

    def _clustered(self) -> DataFrame:
        models, steps = self.models, self.steps

        def place(batches):
            for b in batches:
                dims = b.column("dims").to_numpy()
                for d in np.unique(dims).tolist():
                    some = b.filter(pa.array(dims == d))
                    own, angle, length = models[d].near(_matrix(some.column("vec"), steps))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array(own, pa.int32()), pa.array(angle),
                         pa.array(length)], [*some.schema.names, "cluster", "angle", "length"])

        chosen = self.rows.filter("anchor").select("dims", ROW, "order", "label", "vec")
        return chosen.mapInArrow(place, f"dims int, `{ROW}` long, order long, label long, "
                                        f"vec {self.vec}, cluster int, angle double, "
                                        "length double")

    def best(self, asked: DataFrame, same: bool, most: int, name: str) -> DataFrame:
        """(anchor, slot, row, order, score, _rank): the best ``most`` rows of each query.

        ``asked`` has (anchor, cap, need) with an array element for each slot.
        """
        found = None
        for top in (True, False):
            now = asked
            if found is not None:
                full = (found.filter(F.col("_rank") == most)
                        .groupBy("anchor").agg(F.map_from_entries(F.collect_list(
                            F.struct("slot", "score"))).alias("last")))
                now = (asked.join(full, "anchor", "left").withColumn("need", F.transform(
                    "need", lambda x, i: F.greatest(x, F.element_at("last", i))))
                    .drop("last"))
            members = stored(self.anchors.join(now.withColumnRenamed("anchor", ROW), ROW),
                             f"{name}-members")
            got = self._walked(members, same, most, top)
            if found is not None:
                got = got.unionByName(found.drop("_rank"))
            found = stored(top_per(got, ["anchor", "slot"], [F.desc("score"), "order", "row"],
                                   most), name)
        return found

    def _walked(self, members: DataFrame, same: bool, most: int, top: bool) -> DataFrame:
        models, steps, lists, blocks = self.models, self.steps, self.lists, self.blocks
        # The least bound, by length of a member, that some member of a cluster still needs.
        floor = F.when(F.col("length") > 0, F.array_min("need") / F.col("length")).otherwise(
            F.when(F.array_min("need") < float("inf"), F.lit(float("-inf"))).otherwise(
                F.lit(float("inf"))))
        least = {(d, c): x for d, c, x in members.groupBy("dims", "cluster").agg(
            F.min(floor)).collect()}
        names = ["dims", "cluster", "member_block", "list_block", ROW, "order", "label", "vec",
                 "bound"]

        def send(batches):
            for b in batches:
                dims = b.column("dims").to_numpy()
                for d in np.unique(dims).tolist():
                    if d not in models:
                        continue
                    some, model = b.filter(pa.array(dims == d)), models[d]
                    bound = model.bounds(_matrix(some.column("vec"), steps))
                    mine = some.column("block").to_numpy()
                    for c in range(len(model.centres)):
                        if (d, c) not in least:
                            continue
                        heads = bound[:, c] >= model.head[c]
                        sent = np.flatnonzero(
                            (heads if top else ~heads)
                            & (bound[:, c] + SLACK * np.abs(bound[:, c]) >= least[d, c]))
                        for m in range(blocks[d, c] if len(sent) else 0):
                            take = some.take(pa.array(sent))
                            n = len(sent)
                            yield pa.RecordBatch.from_arrays(
                                [take.column("dims"), pa.array(np.full(n, c, np.int32)),
                                 pa.array(np.full(n, m, np.int32)),
                                 pa.array(mine[sent] % lists[d], pa.int32()),
                                 *(take.column(x) for x in (ROW, "order", "label", "vec")),
                                 pa.array(bound[sent, c])], names)

        listed = (self.rows.select("dims", ROW, "order", "label", "vec",
                                   F.pmod(F.xxhash64(ROW), F.lit(1 << 30)).alias("block"))
                  .mapInArrow(send, "dims int, cluster int, member_block int, list_block int, "
                                    f"`{ROW}` long, order long, label long, vec {self.vec}, "
                                    "bound double"))
        every = [F.struct(F.lit(d).alias("d"), F.lit(c).alias("c"), F.lit(n).alias("n"),
                          F.lit(lists[d]).alias("l")) for (d, c), n in blocks.items()]
        if not every:
            every = [F.struct(*(F.lit(0).alias(n) for n in "dcnl"))]
        own = F.element_at(F.filter(F.array(*every), lambda x: (x["d"] == F.col("dims"))
                                    & (x["c"] == F.col("cluster"))), 1)
        parts = (members.withColumn("own", own)
                 .withColumn("member_block",
                             F.pmod(F.xxhash64(ROW), F.col("own.n")).cast("int"))
                 .withColumn("list_block", F.explode(F.sequence(F.lit(0), F.col("own.l") - 1))))
        sides = parts.select(*names[:-1], F.lit(None).cast("double").alias("bound"), "length",
                             "cap", "need").unionByName(listed, allowMissingColumns=True)

        def meet(group: pa.Table) -> pa.Table:
            anchor = np.asarray(group.column("length").is_valid())
            a, c = group.filter(pa.array(anchor)), group.filter(pa.array(~anchor))
            out = {n: np.zeros(0) for n in ("query", "score", "order", "row")}
            slots, rows = 1, np.zeros(0, np.int64)
            if a.num_rows and c.num_rows:
                c = c.take(pa.array(np.argsort(-c.column("bound").to_numpy(), kind="stable")))
                m, listed = ({"vec": _matrix(t.column("vec"), steps)}
                             | {n: t.column(x).to_numpy() for n, x in (
                                 ("row", ROW), ("order", "order"), ("label", "label"))}
                             for t in (a, c))
                m |= {n: _matrix(a.column(n), 1.0) for n in ("cap", "need")}
                m["length"], listed["bound"] = (t.column(x).to_numpy() for t, x in (
                    (a, "length"), (c, "bound")))
                out, slots, rows = walk(m, listed, same, most), m["cap"].shape[1], m["row"]
            q = out["query"].astype(np.int64)
            score = np.clip(out["score"], -2.0 ** 62, 2.0 ** 62).astype(np.int64)
            return pa.table({"anchor": rows[q // slots] if len(q) else q,
                             "slot": pa.array(q % slots, pa.int32()),
                             "row": out["row"].astype(np.int64),
                             "order": out["order"].astype(np.int64), "score": score})

        return (sides.groupBy("dims", "cluster", "member_block", "list_block")
                .applyInArrow(meet, "anchor long, slot int, row long, order long, score long"))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5,
         band: tuple[int, int] = (80, 100), steps: float = 256.0, clusters: int = 16,
         sample: int = 20_000, head: float = 1 / 16, members: int = MEMBERS,
         listed: int = LISTED, vec: str = "embedding", label: str = "label",
         key: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says which rows are anchors. A negative's score is from ``band[0]`` to ``band[1]``
    percent of the positive's. Components are rounded down to whole 1/``steps``.
    """
    chosen = (rows.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"),
                          F.col(label).cast("long").alias("label"), anchor.alias("anchor"))
              .filter(usable(F.col("vec"), F.col("label"))))
    table = with_rows(chosen.select(
        F.coalesce("id", F.lit(NO_ID)).alias("order"), "vec", "label",
        (F.coalesce("anchor", F.lit(False)) & F.col("id").isNotNull()).alias("anchor"),
        F.size("vec").alias("dims")), "negatives-rows")
    search = Search(table, steps, clusters, sample, head, members, listed)
    inf = float("inf")
    open_ended = search.anchors.select(F.col(ROW).alias("anchor"),
                                       F.array(F.lit(inf)).alias("cap"),
                                       F.array(F.lit(-inf)).alias("need"))
    positive = search.best(open_ended, True, positives, "positives")
    low, high = (F.col("score").cast("double") * percent / 100 for percent in band)
    bands = positive.select("anchor", "_rank", F.floor(high).cast("double").alias("cap"),
                            F.ceil(low).cast("double").alias("need"))
    bands = bands.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        "_rank", "cap", F.when(F.col("need") <= F.col("cap"), F.col("need")).otherwise(inf)
        .alias("need")))).alias("p"))
    missing = F.lit(positives) - F.size("p")
    asked = bands.select("anchor",
                         F.concat("p.cap", F.array_repeat(F.lit(-inf), missing)).alias("cap"),
                         F.concat("p.need", F.array_repeat(F.lit(inf), missing)).alias("need"))
    negative = search.best(asked, False, negatives, "negatives")
    anchors = search.anchors.select(F.col(ROW).alias("anchor"), F.col("order").alias("anchor_id"))
    pairs = positive.select("anchor", (F.col("_rank") - 1).alias("slot"),
                            F.nullif("order", F.lit(NO_ID)).alias("positive_id"),
                            F.col("score").alias("positive_score"))
    return (negative.join(pairs, ["anchor", "slot"]).join(anchors, "anchor")
            .select("anchor_id", "positive_id", F.col("_rank").alias("rank"),
                    F.nullif("order", F.lit(NO_ID)).alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
