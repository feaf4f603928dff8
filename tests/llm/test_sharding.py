"""Best-fit decreasing against a plain search of all shards, and what shards must hold."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tripweave.llm import sharding


def plain_fit(sizes, rooms):
    rooms, out = list(rooms), []
    for size in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= size]
        r, i = min(fits) if fits else max((r, i) for i, r in enumerate(rooms))
        rooms[i] -= size
        out.append(i)
    return out


def test_tree_finds_what_a_plain_search_finds():
    rnd = random.Random(4)
    for n in (1, 2, 7, 40, 300):
        sizes = sorted((rnd.randint(1, 90) for _ in range(1500)), reverse=True)
        rooms = [rnd.choice([0, 50, -(-sum(sizes) // n)]) for _ in range(n)]
        assert sharding.best_fit(sizes, rooms).tolist() == plain_fit(sizes, rooms)


def test_tree_stays_balanced():
    tree = sharding.Rooms([1000] * 500)
    rnd = random.Random(1)
    for _ in range(3000):
        tree.take(tree.fitting(rnd.randint(1, 30)), rnd.randint(1, 30))

    def depth(i):
        if i < 0:
            return 0
        a, b = depth(tree.left[i]), depth(tree.right[i])
        assert abs(a - b) <= 1
        return 1 + max(a, b)
    assert depth(tree.root) <= 13


def check_whole(rows, texts, shards):
    """Every document once, with its size, in gapless slots of a shard."""
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert got == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                          for k, t in texts)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(r.shard, r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)


@pytest.mark.parametrize("room_rows", [sharding.ROOM_ROWS, 1])
def test_shards_are_even_and_copies_stay_together(spark, room_rows):
    rnd = random.Random(7)
    texts = [(i, "".join(rnd.choice("abcé \n") for _ in range(int(rnd.expovariate(1 / 60)))))
             for i in range(3000)]
    texts += [(None, None), (5, None), (5, ""), (9000, "long " * 400)]
    texts += [(10_000 + i, f"copied {i % 9}" * 5) for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr(
        "*", "1 AS size", "'x' AS shard", "0 AS h1")
    rows = sharding.shard(docs, shards=8, room_rows=room_rows).collect()
    check_whole(rows, texts, 8)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    mean = sum(sums.values()) / 8
    # One room has 3,000 groups, or about 500 with 64 for each shard.
    assert max(abs(b - mean) for b in sums.values()) < (40 if room_rows > 1 else 0.02 * mean)
    where = defaultdict(set)
    text_of = {(r.doc_id, r.text_crc32): r.shard for r in rows}
    for k, t in texts:
        where[t or ""].add(text_of[k, zlib.crc32((t or "").encode())])
    assert all(len(s) == 1 for s in where.values())


def test_single_room_is_best_fit_decreasing(spark):
    rnd = random.Random(3)
    texts = [(i, "x" * rnd.randint(0, 500) + str(i)) for i in range(200)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 5).collect()
    sizes = sorted((len(t) + 16 for _, t in texts), reverse=True)
    fits = plain_fit(sizes, [-(-sum(sizes) // 5)] * 5)
    want = Counter((shard, size) for shard, size in zip(fits, sizes))
    assert Counter((r.shard, r.size) for r in rows) == want


def test_hot_copies_are_cut_and_a_huge_text_has_its_own_shard(spark):
    texts = [(i, "copied text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(300)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 10).collect()
    check_whole(rows, texts, 10)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) < 60
    copies = {r.shard for r in rows if r.doc_id < 400}
    assert len(copies) <= 7          # of 27 bytes each: six full shards hold 384, a seventh the rest
    huge = texts + [(9999, "y" * 50_000)]
    rows = sharding.shard(spark.createDataFrame(huge, "doc_id long, text string"), 10).collect()
    check_whole(rows, huge, 10)
    alone = next(r.shard for r in rows if r.doc_id == 9999)
    assert [r.doc_id for r in rows if r.shard == alone] == [9999]


def test_fixed_capacity_is_kept(spark):
    rnd = random.Random(5)
    texts = [(i, "x" * rnd.choice([34, 35, 44, 84]) ) for i in range(60)]
    docs = spark.createDataFrame([(i, t + chr(97 + i % 26) + str(i)) for i, t in texts],
                                 "doc_id long, text string")
    rows = sharding.shard(docs, capacity=120).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) <= 120
    with pytest.raises(ValueError):
        sharding.shard(docs, capacity=60)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs, 40).isEmpty()
