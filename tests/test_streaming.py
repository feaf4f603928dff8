"""The search stream: repeats, quarantine, the off switch, and equality with batch."""

import datetime as dt
import time
from collections import Counter

import pytest

from tripweave.operators.analytics import popular_pairs, route_demand, searches_per_hour, unmet_demand
from tripweave.sources.tables import SCHEMAS, Tables
from tripweave.streaming import searches as S

T0 = dt.datetime(2026, 1, 1, 10, 0)


def _event(i, minutes, endpoint="/api/plan", options=1):
    o = [("000001", "LINE", "WEEKDAY", k) for k in range(options)]
    return (i, endpoint, 5, None, None, None, -34.0, 18.5, o, 12, T0 + dt.timedelta(minutes=minutes))


def _write(spark, rows, path):
    spark.createDataFrame(rows, S.EVENT).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 100, 500])
def test_hours_are_exact_for_any_files(spark, tmp_path, files):
    """Events of ten days in random order, each third one delivered again in another batch."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = [_event(i, 13 * (i * 7919 % 1100), options=i % 3) for i in range(1100)]
    rows = events + events[::3]
    df = spark.createDataFrame([(i % files, *r) for i, r in enumerate(rows)],
                               "part int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.EVENT))
    df.repartition(files, "part").drop("part").write.parquet(src)
    S.record_searches(S.event_stream(spark, src, files_per_batch=50), out, str(tmp_path / "ck")).awaitTermination()
    t = S.recorded(spark, out)
    assert sorted(r["id"] for r in t.search_analytics.collect()) == list(range(1100))
    got = {r["hour"]: r["searches"] for r in searches_per_hour(t, limit=None).collect()}
    assert got == Counter(e[-1].replace(minute=0) for e in events)
    assert t.search_analytics_option.count() == sum(len(e[8]) for e in events)
    # Reports over the counts of all runs equal those over the rows.
    stops = Tables(spark, {"stop": lambda: spark.createDataFrame([], SCHEMAS["stop"])})
    rows = stops.replacing(search_analytics=t.search_analytics, search_analytics_option=t.search_analytics_option)
    counts = rows.replacing(**{c: getattr(t, c) for c in S.COUNTS})
    for report in (route_demand, popular_pairs, unmet_demand, searches_per_hour):
        assert report(counts, limit=None).collect() == report(rows, limit=None).collect() != []


def _run(spark, src, out, ck, **more):
    S.record_searches(S.event_stream(spark, src, files_per_batch=1), out, ck, **more).awaitTermination()


def test_runs_stay_few_and_a_batch_reads_no_older_one(spark, tmp_path):
    """After 11 batches at 3 runs to a larger one, 4 runs hold everything; the last batch read
    what it joined and nothing else."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for i in range(11):
        _write(spark, [_event(i * 10 + k, 7 * i) for k in range(10)] + [_event(max(0, i * 10 - 15), 7)], src)
    _run(spark, src, out, ck, fan=3)
    log = S.Log(spark, out)
    runs = log.entry(log.last())["runs"]
    assert [r["name"] for r in runs] == ["0-8", "9-9", "10-10"]
    t = S.recorded(spark, out)
    assert sorted(r["id"] for r in t.search_analytics.collect()) == list(range(110))
    assert t.searches_by_hour.groupBy().sum("searches").first()[0] == 110
    # Runs that were joined are removed a batch later.
    assert sorted(p.name for p in (tmp_path / "out" / "search_analytics").iterdir() if p.name[0] != ".") == [
        "run=0-8", "run=10-10", "run=9-9"]


def test_repeats_after_the_state_is_gone_are_looked_up_by_day(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    first = [_event(i, 500 * i) for i in range(20)]
    _write(spark, first, src)
    _run(spark, src, out, ck, keep="1 second")
    for again in range(3):
        time.sleep(2.5)
        _write(spark, [_event(100 + again, 9)] + first, src)
        _run(spark, src, out, ck, keep="1 second")
    ids = sorted(r["id"] for r in S.recorded(spark, out).search_analytics.collect())
    assert ids == [*range(20), 100, 101, 102]


def test_one_event_with_two_times_is_recorded_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    _write(spark, [_event(1, 0)], src)
    _write(spark, [_event(1, 5000), _event(2, 0)], src)
    _run(spark, src, out, ck)
    assert sorted(r["id"] for r in S.recorded(spark, out).search_analytics.collect()) == [1, 2]


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    """The checkpoint forgets that the last batch was committed, as after a crash."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for i in range(4):
        _write(spark, [_event(i * 10 + k, 70 * i + k, options=2) for k in range(10)], src)
    _run(spark, src, out, ck, fan=2)
    rows = lambda: sorted(map(str, S.recorded(spark, out).search_analytics.collect()))
    before = rows()
    for f in (tmp_path / "ck" / "commits").iterdir():
        if f.name.lstrip(".").startswith("3"):
            f.rename(tmp_path / f.name)
    _run(spark, src, out, ck, fan=2)
    assert rows() == before and len(before) == 40
    assert S.recorded(spark, out).search_analytics_option.count() == 80


def test_recording_quarantines_and_can_be_off(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, [_event(1, 0, options=2), _event(2, 1, endpoint=None), _event(3, 2, options=0)], src)
    events = S.event_stream(spark, src)
    assert S.record_searches(events, out, str(tmp_path / "off"), enabled=False) is None
    S.record_searches(events, out, str(tmp_path / "ck")).awaitTermination()
    rows = {r["id"]: r for r in spark.read.parquet(out + "/search_analytics").collect()}
    assert set(rows) == {1, 3} and rows[1]["option_count"] == 2 and rows[3]["option_count"] == 0
    assert rows[1]["from_kind"] == "stop" and rows[1]["to_kind"] == "pin"
    assert spark.read.parquet(out + "/search_analytics_option").count() == 2
    _write(spark, [_event(None, 0), _event(None, 0), _event(2, 1, endpoint=None)], src)
    S.record_searches(events, out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out + "/search_quarantine").count() == 4
