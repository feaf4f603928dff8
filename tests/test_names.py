"""The name index against a test of every name."""

import random

import pytest
from pyspark.sql import functions as F

from tripweave.operators import catalog
from tripweave.operators.names import holds, index_names

TEXTS = ["", "%", "_", "%_%", "nat", "nation", "NATION 7", "ion_1", "x%9", "é", "ÉÜ", "12", "1", " ", "zzz",
         "qqz", "7 é", "n 19%", "ation 1234", "a", "ab", "abc", None, "İs", "\0"]


def names_of(spark, n):
    rnd = random.Random(2)
    rows = [(i, f"Nation {i} {rnd.choice(['éü', 'x', 'İst', ''])}") for i in range(n)]
    rows += [(n + 1, ""), (n + 2, "a"), (n + 3, "AB"), (n + 4, None), (n + 5, "ab"), (n + 5, "ab"), (n + 6, "a\0b")]
    return spark.createDataFrame(rows, "id long, name string")


def test_equals_a_test_of_every_name(spark):
    names = names_of(spark, 1500)
    asked = spark.createDataFrame([(q,) for q in TEXTS + TEXTS[:5]], "q string")
    got = index_names(names, "name", 100).find(asked).select("q", "id", "name")
    want = asked.distinct().crossJoin(names).filter(holds("name", F.col("q")))
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert text(got) == text(want.select("q", "id", "name"))


def test_a_piece_in_every_name_makes_no_large_key(spark):
    size = 500
    index = index_names(names_of(spark, 20_000), "name", size)
    most = index.lists.agg(F.max(F.size("nos"))).first()[0]
    assert most < 1.3 * size
    assert index.lists.groupBy("piece", "part").count().filter("count > 1").isEmpty()
    # "nation 12345" meets the names of its rarest piece only, not all that have "nation".
    asked = spark.createDataFrame([("nation 12345",), ("nation 77",)], "q string")
    tried = {r.q: r.n for r in index.candidates(asked).groupBy("q").agg(F.count("*").alias("n")).collect()}
    assert tried["nation 12345"] < 300 and tried["nation 77"] < 1500
    # A text with no rare piece finds all names over many keys.
    assert index.find(spark.createDataFrame([("nation",)], "q string")).count() == 20_000


@pytest.mark.parametrize("limit", [1, 3])
def test_stop_search_puts_beginnings_first(spark, limit):
    from tests.test_operators import network
    t = network(spark, {1: ("A", "WEEKDAY", [1, 11, 2], [[500, 510, 520]])})
    asks = spark.createDataFrame([(1, "1"), (2, "s1"), (3, "no such"), (4, None)], "request_id long, q string")
    got = sorted((r.request_id, r["rank"], r.stop_id) for r in catalog.search_stops(t, asks, limit).collect())
    want = [(1, 1, 1), (1, 2, 11), (2, 1, 1), (2, 2, 11), (4, 1, 1), (4, 2, 11), (4, 3, 2)]
    assert got == [w for w in want if w[1] <= limit]
