"""Sections laid out where they are gathered, against the same sections row by row."""

import random

from tripweave.sources import pages as P

SCHEMA = "pdf_filename string, page_number int, line_no int, line string"
TABLES = ("stops", "trips", "cells", "schedules", "notes", "files")


def made_up():
    rnd = random.Random(4)
    cells = ["05:30a", "5:07", "24:10", "via", "VIA", "--", "", "junk", " 09:00 ", "10:00  ", "7:61bc", " "]
    pages = []
    for i in range(60):
        page = [f"LINE {i}", "SATURDAYS EFFECTIVE DATE: 2026/06/22 TIMETABLE NUMBER: 0044 01"]
        for block in range(rnd.randint(1, 3)):
            names = [f"STOP {k}" for k in range(rnd.randint(1, 6))]
            if i % 3:
                rnd.shuffle(names)
            if i % 5 == 0:
                names.append(names[0])
            width = rnd.randint(0, 4)
            for name in names:
                page.append("|" + rnd.choice(["", " ", "  "]) + name + rnd.choice(["|", " | "]) + rnd.choice(
                    ["|", " | ", " |", "| "]).join(rnd.choice(cells) for _ in range(rnd.randint(max(0, width - i % 2), width)))
                    + rnd.choice(["|", " |", ""]))
            page.append("|---|---|" if block == 0 else "SUNDAYS")
        page += ["ABBREVIATIONS", "a - Mondays", "| GHOST | 10:00 |"]
        pages.append((f"f{i % 9}.pdf", i, page))
    return [(f, i, n, line) for f, i, page in pages for n, line in enumerate(page)]


def rows(parsed, table):
    df = getattr(parsed, table)
    return df.columns, df.dtypes, sorted((tuple(map(str, r)) for r in df.collect()))


def test_equals_row_by_row(spark, monkeypatch):
    lines = spark.createDataFrame(made_up(), SCHEMA)
    whole = P.parse(lines)
    got = {t: rows(whole, t) for t in TABLES}
    assert whole._odd is not None and whole._sheets.filter("holed").count() > 3
    monkeypatch.setattr(P, "BLOCK", 2)
    cut = P.parse(lines)
    assert {t: rows(cut, t) for t in TABLES} == got
    assert cut._sheets.isEmpty() and len(got["cells"][2]) > 300


def test_tables_are_read_off_without_moving(spark):
    """Stops, trips and cells of sections that are gathered need no exchange and no join."""
    page = ["TITLE", "SUNDAYS", "| A | 10:00a | via |", "| B | 10:10 |", "|--|--|", "| A | 11:00 |"]
    parsed = P.parse(spark.createDataFrame([("f", 1, n, x) for n, x in enumerate(page)], SCHEMA))
    for table in ("stops", "trips", "cells"):
        plan = getattr(parsed, table)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    got = {(r.trip_index, r.stop_name): (r.cell_type, r.dep_min, r.note_code) for r in parsed.cells.collect()}
    assert got == {(0, "A"): ("TIME", 600, "a"), (0, "B"): ("TIME", 610, None), (1, "A"): ("VIA", None, None),
                   (1, "B"): ("NONE", None, None), (2, "A"): ("TIME", 660, None), (2, "B"): ("NONE", None, None)}


def test_cells_are_cut_where_their_schedule_lies(spark):
    """Loaded cells, their stops and visits lie in buckets of the schedule and aren't moved to meet."""
    from pyspark.sql import functions as F

    from tripweave.sources.network import visits

    for data in (made_up(), [r for r in made_up() if r[1] % 5]):
        parsed = P.parse(spark.createDataFrame(data, SCHEMA))
        ids = parsed.schedules.select(*P.SECTION, F.xxhash64(*P.SECTION).alias("schedule_id")).filter(
            "page_number % 4 <> 1")
        got = parsed.cells_in_buckets(ids)
        want = parsed.cells.join(ids, P.SECTION).select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = visits(got.withColumn("stop_id", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_a_run_leaves_out_what_it_supersedes(spark):
    """A run that prunes in one pass gives what loading and pruning one after another gave."""
    from pyspark.sql import functions as F

    from tripweave.operators import merge as G
    from tripweave.plans.ingest import parsed
    from tripweave.plans.upkeep import _TABLES, _fetched, current_manifest
    from tripweave.sources.network import load

    sf = "/root/testdata/sf0.001"
    t, m, at = load(spark, sf), current_manifest(spark, sf).filter("pdf_filename LIKE '%3.pdf'"), F.lit(
        "2026-02-01 00:00:00").cast("timestamp")
    one = G.ingest(t, m, _fetched(m), parsed(spark, sf), at)
    two = G.prune_superseded(G.load_batch(t, m, _fetched(m), parsed(spark, sf), at), m)
    for name in _TABLES:
        a = getattr(one, name)
        b = getattr(two, name).select(a.columns)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
    assert one.visit.count() > 0
    plan = one.stop_time._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
