"""Hard negatives against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, slot string"


def brute(rows, positives=5, negatives=5):
    fit = [(i, r[0], [math.floor(256 * x) for x in r[1]], r[2]) for i, r in enumerate(rows)
           if r[1] is not None and r[2] is not None
           and all(x is not None and math.isfinite(x) for x in r[1])]
    far = float("inf")
    out = []
    for i, key, v, label in fit:
        if key is None or key % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), far if k is None else k, j, k, m)
                  for j, k, w, m in fit if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: x[:3])
        for p, _, _, pid, _ in [x for x in scored if x[4] == label][:positives]:
            band = [x for x in scored if x[4] != label and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out += [(key, pid, rank, x[3], -p, -x[0])
                    for rank, x in enumerate(band[:negatives], 1)]
    return out


def made(n, seed, spread):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        # Few distinct steps, so equal scores are common.
        v = [round(x + rnd.gauss(0, spread), 1) / 4 for x in c]
        rows.append((i, v, rnd.randrange(3), 0.0, "x"))
    return rows


@pytest.mark.parametrize("spread, members, listed", [(0.3, 1024, 8192), (2.0, 7, 40)])
def test_equals_all_pairs(spark, spread, members, listed):
    rows = made(400, 1, spread)
    rows += [(None, rows[3][1], 1, 0.0, ""), (410, None, 1, 0.0, ""), (420, [1.0] * 6, None, 0.0, ""),
             (430, [1.0, None] * 3, 1, 0.0, ""), (440, [float("nan")] * 6, 1, 0.0, ""),
             (450, [0.0] * 6, 1, 0.0, ""), (460, [0.5, 0.25], 1, 0.0, ""), (461, [0.5, 0.25], 1, 0.0, ""),
             (462, [0.45, 0.25], 2, 0.0, ""), (470, [], 1, 0.0, ""), (470, [], 1, 0.0, ""),
             (480, [float("inf")] * 6, 1, 0.0, "")]
    rows += [rows[10], rows[10], rows[20], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, clusters=4, members=members,
                              listed=listed).collect()
    text = lambda x: str(tuple(x))
    assert sorted(map(text, got)) == sorted(map(text, brute(rows)))


def test_hot_vector_and_few_rows(spark):
    rows = [(i, [0.5, 0.5, 0.1], i % 2, 0.0, "") for i in range(60)] + made(0, 1, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, members=3, listed=8).collect()
    text = lambda x: str(tuple(x))
    assert sorted(map(text, got)) == sorted(map(text, brute(rows)))
    two = spark.createDataFrame(rows[:2], SCHEMA)
    assert hard_negatives.mine(two, F.col("vec_id") % 10 == 0).isEmpty()


def test_no_anchors_and_empty_table(spark):
    df = spark.createDataFrame(made(20, 1, 1), SCHEMA)
    assert hard_negatives.mine(df, F.lit(False)).isEmpty()
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).isEmpty()
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).isEmpty()


def test_a_walk_ends_early_where_bounds_allow():
    import numpy as np
    rng = np.random.default_rng(0)
    centre = np.zeros(32)
    centre[0] = 1
    a = np.floor(256 * (centre + rng.normal(0, .01, (5, 32))))
    c = np.floor(256 * np.vstack([centre + rng.normal(0, .01, (600, 32)),
                                  -centre + rng.normal(0, .01, (4000, 32))]))
    model = hard_negatives.Clusters(a, 1)
    own, angle, length = model.near(a)
    model.radius[0] = angle.max()
    bound = model.bounds(c)[:, 0]
    at = np.argsort(-bound)

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Counted.read = max(Counted.read, key.stop)
            return np.asarray(super().__getitem__(key))
    listed = {"vec": c[at].view(Counted), "row": at, "order": at, "bound": bound[at],
              "label": np.zeros(len(at), int)}
    members = {"vec": a, "row": np.arange(10_000, 10_005), "label": np.zeros(5, int),
               "length": length, "cap": np.full((5, 1), np.inf), "need": np.full((5, 1), -np.inf)}
    found = hard_negatives.walk(members, listed, True, 5)
    score = a @ c.T
    for i in range(5):
        want = sorted(range(len(c)), key=lambda j: (-score[i, j], j))[:5]
        assert list(found["row"][found["query"] == i]) == want
    assert Counted.read < len(at) / 2
