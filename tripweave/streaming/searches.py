"""The search feed as a stream, recorded once per event; reports read what is recorded.

Ids of events are kept as state for ``keep`` after they arrive, in RocksDB, and a repeat within
that time is dropped there, whatever its day and order. For events that repeat later than that,
rows recorded before are looked up by the event's day, in the folders old enough to matter only.

What batches record is kept as runs of batches: ``fan`` runs of one size become one run of the
next, so after n batches there are at most ``fan - 1`` runs of each of log(n) sizes, however
small the batches were, and a row is written again as often as there are sizes. A batch ends with
a log entry that names the runs that hold; readers take the runs of the last entry, a batch that
is tried again writes the same folders again, and runs that no longer hold are removed one batch
later. Searches are counted by hour as they are recorded, so hourly volume reads counts only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.analytics import (ROUTE_KEY, event_rows, hour_counts, option_rows, pair_counts,
                                   route_counts)
from ..sources.tables import SCHEMAS, Tables

OPTION = T.StructType([
    T.StructField("timetable_number", T.StringType()), T.StructField("route_label", T.StringType()),
    T.StructField("day_type", T.StringType()), T.StructField("departure_count", T.IntegerType())])
EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("endpoint", T.StringType()),
    T.StructField("from_stop_id", T.LongType()), T.StructField("from_lat", T.DoubleType()),
    T.StructField("from_lon", T.DoubleType()), T.StructField("to_stop_id", T.LongType()),
    T.StructField("to_lat", T.DoubleType()), T.StructField("to_lon", T.DoubleType()),
    T.StructField("options", T.ArrayType(OPTION)), T.StructField("duration_ms", T.LongType()),
    T.StructField("searched_at", T.TimestampType())])
SEARCH = T.StructType(SCHEMAS["search_analytics"].fields + [
    T.StructField("arrived", T.TimestampType()), T.StructField("run", T.StringType()),
    T.StructField("day", T.DateType())])
_LONG = T.LongType()
#: Counts kept by run: the columns they are of, and the counts, which add up.
COUNTS = {
    "searches_by_hour": ({"hour": T.TimestampType()}, ["searches"]),
    "route_counts": ({c: T.StringType() for c in ROUTE_KEY}, ["searches", "departures_offered"]),
    "pair_counts": ({"from_stop_id": _LONG, "to_stop_id": _LONG},
                    ["searches", "options", "answered", "failed_searches"])}
TABLES = ["search_analytics", "search_analytics_option", *COUNTS]


def _counts_schema(table: str) -> T.StructType:
    keys, sums = COUNTS[table]
    return T.StructType([T.StructField(n, k) for n, k in (keys | dict.fromkeys(sums, _LONG)).items()])


def _added_up(rows: DataFrame, table: str) -> DataFrame:
    keys, sums = COUNTS[table]
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

#: Log entries kept; a batch that is tried again reads the one before it.
ENTRIES = 100
#: State is dropped with the next batch that has events, not by a batch of its own.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Search events arriving as parquet files."""
    return (spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch)
            .parquet(folder))


def usable(events: DataFrame):
    """The test an event must pass to be recorded."""
    return F.col("event_id").isNotNull() & F.col("endpoint").isNotNull() & F.col(
        "searched_at").isNotNull()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Log:
    """Which runs of batches hold, by the entry of the last batch that ended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def last(self) -> int:
        path, fs = _path(self.spark, f"{self.root}/log")
        if not fs.exists(path):
            return -1
        begun = sorted((int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)), reverse=True)
        return next((n for n in begun if fs.exists(
            _path(self.spark, f"{self.root}/log/batch={n}/_SUCCESS")[0])), -1)

    def entry(self, n: int) -> dict:
        if n < 0:
            return {"runs": [], "gone": []}
        return json.loads(self.spark.read.text(f"{self.root}/log/batch={n}").first()[0])

    def write(self, n: int, entry: dict) -> None:
        (self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{self.root}/log/batch={n}"))
        path, fs = _path(self.spark, f"{self.root}/log/batch={n - ENTRIES}")
        fs.delete(path, True)

    def remove(self, runs: list[dict]) -> None:
        for table in TABLES:
            for run in runs:
                path, fs = _path(self.spark, f"{self.root}/{table}/run={run['name']}")
                fs.delete(path, True)

    def read(self, table: str, schema: T.StructType, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.root}/{table}"
        return (self.spark.read.schema(schema).option("basePath", folder)
                .parquet(*(f"{folder}/run={r['name']}" for r in runs)))


def merged_from(n: int, fan: int) -> int:
    """The first batch of the run that batch ``n`` ends."""
    size = 1
    while (n + 1) % (size * fan) == 0:
        size *= fan
    return n + 1 - size


def record_searches(events: DataFrame, root: str, checkpoint: str, enabled: bool = True,
                    available_now: bool = True, keep: str = "1 day", fan: int = 8) -> StreamingQuery | None:
    """Appends search rows and option rows under ``root``, once for each event id however
    often and however late it is delivered; unusable events go to a quarantine folder, each as
    often as it comes, and never stop the feed. Nothing is started when disabled.
    """
    if not enabled:
        return None
    spark = events.sparkSession
    odd = F.when(~usable(events), F.uuid())
    once = (events.withColumn("arrived", F.current_timestamp()).withColumn("odd", odd)
            .withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["event_id", "odd"]))

    def write(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        log = Log(session, root)
        now = log.entry(n - 1)
        # Written once: the state is asked once, and what follows reads the files.
        taken = f"{root}/taken/batch={n % 2}"
        batch.write.mode("overwrite").parquet(taken)
        batch = session.read.schema(batch.schema).parquet(taken)
        good = batch.filter("odd IS NULL").withColumn("day", F.to_date("searched_at"))
        arrived = batch.agg(F.min("arrived").cast("double"), (
            F.min("arrived") - F.expr(f"INTERVAL {keep}")).cast("double")).first()
        old = [r for r in now["runs"] if arrived[1] is not None and r["arrived"] < arrived[1]]
        if old:
            seen = log.read("search_analytics", SEARCH, old).select("day", F.col("id").alias("event_id"))
            good = good.join(seen.join(good.select("day").distinct(), "day", "left_semi"),
                             ["day", "event_id"], "left_anti")
        first = merged_from(n, fan)
        joined = [r for r in now["runs"] if r["first"] >= first]
        run = {"name": f"{first}-{n}", "first": first, "arrived": min(
            [r["arrived"] for r in joined] + [arrived[0] or float("inf")])}

        def put(table: str, schema: T.StructType, rows: DataFrame, *by: str) -> None:
            names = [f.name for f in schema if f.name != "run"]
            rows = rows.select(*names)
            if joined:
                rows = log.read(table, schema, joined).select(*names).unionByName(rows)
                if table in COUNTS:
                    rows = _added_up(rows, table)
                elif by:
                    rows = rows.repartitionByRange(*by, names[0])
            out = rows.write.mode("overwrite")
            (out.partitionBy(*by) if by else out).parquet(f"{root}/{table}/run={run['name']}")

        rows = event_rows(good, "arrived").withColumn("day", F.to_date("searched_at"))
        options = option_rows(good)
        counted = {"searches_by_hour": hour_counts(rows), "route_counts": route_counts(options),
                   "pair_counts": pair_counts(rows)}
        put("search_analytics_option", SCHEMAS["search_analytics_option"], options)
        put("search_analytics", SEARCH, rows, "day")
        for table, counts in counted.items():
            put(table, _counts_schema(table), counts)
        batch.filter("odd IS NOT NULL").drop("odd", "arrived").write.mode("overwrite").parquet(
            f"{root}/search_quarantine/batch={n}")
        log.write(n, {"runs": [r for r in now["runs"] if r["first"] < first] + [run],
                      "gone": joined})
        log.remove(now["gone"])

    w = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    # A started query keeps its own settings.
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def recorded(spark: SparkSession, root: str) -> Tables:
    """The recorded rows as tables, for every report over searches: exact at any time,
    whatever the order and the number of files events came in."""
    log = Log(spark, root)
    runs = log.entry(log.last())["runs"]
    options = SCHEMAS["search_analytics_option"]
    return Tables(spark, {
        "search_analytics": lambda: log.read("search_analytics", SEARCH, runs).drop(
            "arrived", "run", "day"),
        "search_analytics_option": lambda: log.read("search_analytics_option", options, runs).select(
            *options.names),
    } | {c: lambda c=c: _added_up(log.read(c, _counts_schema(c), runs), c) for c in COUNTS})
