"""The table set: what the operators read, and where it is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

_I, _S, _D, _B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
_N, _DT, _TS = T.IntegerType(), T.DateType(), T.TimestampType()
POINT = T.StructType([T.StructField("lat", _D), T.StructField("lon", _D)])
PATH = T.ArrayType(POINT)


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


# Schedules, trips and cells are identified by their natural keys: (schedule_id,
# stop_sequence), (schedule_id, trip_index) and all three. Clock times are minutes past
# midnight. stop_time carries its stop_id so that most questions need no second join.
SCHEMAS: dict[str, T.StructType] = {
    "route": _schema(id=_I, name=_S, origin=_S, destination=_S, letter_group=_S),
    "timetable": _schema(id=_I, route_id=_I, timetable_number=_S, is_public_holiday=_B,
                         effective_from=_DT, effective_to=_DT, pdf_url=_S, pdf_filename=_S,
                         pdf_sha256=_S, page_count=_N, parse_status=_S, parse_error=_S,
                         scraped_at=_TS, parsed_at=_TS),
    "timetable_text": _schema(timetable_id=_I, page_number=_I, line_no=_I, line=_S),
    "timetable_note": _schema(timetable_id=_I, code=_S, description=_S),
    "stop": _schema(id=_I, name=_S, lat=_D, lon=_D, geocoded_at=_TS, geocode_source=_S),
    "schedule": _schema(id=_I, timetable_id=_I, page_number=_I, direction_index=_I,
                        direction_label=_S, day_type=_S, day_label=_S,
                        section_timetable_number=_S, section_effective_date=_DT,
                        no_service=_B),
    "schedule_stop": _schema(schedule_id=_I, stop_sequence=_I, stop_id=_I),
    "trip": _schema(schedule_id=_I, trip_index=_I, note_codes=T.ArrayType(_S)),
    "stop_time": _schema(schedule_id=_I, trip_index=_I, stop_sequence=_I, stop_id=_I,
                         cell_type=_S, dep_min=_N, note_code=_S, raw_value=_S),
    # Served cells with the latest time printed before and the earliest printed after.
    "visit": _schema(schedule_id=_I, trip_index=_I, stop_sequence=_I, stop_id=_I,
                     cell_type=_S, dep_min=_N, note_code=_S, raw_value=_S,
                     prior_min=_N, next_min=_N),
    "leg_geometry": _schema(from_stop_id=_I, to_stop_id=_I, path=PATH, length_m=_D,
                            min_lat=_D, min_lon=_D, max_lat=_D, max_lon=_D, source=_S,
                            fetched_at=_TS),
    "search_analytics": _schema(id=_I, endpoint=_S, from_kind=_S, from_stop_id=_I,
                                from_lat=_D, from_lon=_D, to_kind=_S, to_stop_id=_I,
                                to_lat=_D, to_lon=_D, option_count=_N, duration_ms=_I,
                                searched_at=_TS),
    "search_analytics_option": _schema(search_id=_I, timetable_number=_S, route_label=_S,
                                       day_type=_S, departure_count=_N),
}


class Tables:
    """A set of named DataFrames, each built on first use."""

    def __init__(self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name not in self._builders:
                raise AttributeError(f"no table {name!r}")
            self._built[name] = self._builders[name]()
        return self._built[name]

    @property
    def next_stop(self) -> DataFrame:
        """Each stop of a schedule with the one printed after it, written once for a table set.

        Joined on (schedule, sequence), which stays unique however long a schedule is.
        """
        if "next_stop" not in self._built:
            here = self.schedule_stop.select("schedule_id", "stop_sequence",
                                             F.col("stop_id").alias("from_stop_id"))
            after = self.schedule_stop.select(
                "schedule_id", (F.col("stop_sequence") - 1).alias("stop_sequence"),
                F.col("stop_id").alias("to_stop_id"))
            self._built["next_stop"] = stored(
                here.join(after, ["schedule_id", "stop_sequence"]), "next_stop")
        return self._built["next_stop"]

    def kept(self, name: str, make: Callable[[], object]):
        """Something worked out of these tables, made at its first use."""
        if name not in self._built:
            self._built[name] = make()
        return self._built[name]

    def names(self) -> list[str]:
        return list(self._builders)

    def replacing(self, **tables: DataFrame) -> "Tables":
        """The same set with some tables swapped."""
        builders = {n: (lambda n=n: getattr(self, n)) for n in self._builders}
        builders.update({n: (lambda df=df: df) for n, df in tables.items()})
        return Tables(self.spark, builders)


def from_parquet(spark: SparkSession, root: str,
                 names: Iterable[str] | None = None) -> Tables:
    """A table set stored as one parquet folder per table."""
    def reader(n):
        return lambda: spark.read.schema(SCHEMAS[n]).parquet(f"{root.rstrip('/')}/{n}")
    return Tables(spark, {n: reader(n) for n in (names or SCHEMAS)})


def to_parquet(tables: Tables, root: str, names: Iterable[str] | None = None) -> None:
    """Write a snapshot into a new folder; readers switch once every table is there."""
    for n in names or tables.names():
        getattr(tables, n).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{n}")


def from_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              parts: int = 64, **options: str) -> DataFrame:
    """One database table, read in parallel key ranges."""
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
                     upperBound=str(upper), numPartitions=str(parts), **options)
            .load())


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
