"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLE = "tripweave_"
#: Off, tables in buckets of one column also serve joins on that column and others.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
BUCKET_ROWS = 1 << 20


def build_session(app: str = "tripweave", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution splits hot join keys and turns small sides into broadcasts by
    their measured size, so no operator carries a broadcast hint.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config(CO_PARTITION, "false")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if master and master.startswith("local"):
        # Small local inputs would otherwise end up in one task each.
        b = (b.config("spark.driver.memory", os.environ.get("TRIPWEAVE_DRIVER_MEMORY", "16g"))
             .config("spark.sql.files.openCostInBytes", "65536")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master falls back to a temporary folder; on a cluster an unset
    folder is an error, because a machine-local path would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tripweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where this application writes: one folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"


def remove_written(spark: SparkSession) -> None:
    """Deletes all that this application has ``stored``; call it when its results are out.

    Frames made before can't be read afterwards. Folders of other applications stay.
    """
    for table in spark.catalog.listTables():
        if table.name.startswith(TABLE):
            spark.sql(f"DROP TABLE {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, *sort: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files.

    With ``sort`` the rows are range-partitioned and sorted on those columns, so file
    and row-group min/max values let later scans skip. Range partitioning cuts by the
    full column list, so one hot leading value still spreads over many files.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets_for(spark: SparkSession, about: int) -> int:
    """Buckets of a table of ``about`` rows: of ``BUCKET_ROWS`` each, and as many as there are
    shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-about // BUCKET_ROWS))


def stored_in_buckets(df: DataFrame, name: str, about: int, by: str, *sort: str,
                      in_place: bool = False) -> DataFrame:
    """As ``stored``, in buckets of ``by``: joins and aggregations on it find equal values in
    one bucket and don't move the table.

    ``about`` is a rough number of rows, see ``buckets_for``. Each bucket is one file, sorted by
    ``by`` and ``sort``. ``in_place`` says that ``df`` was made of a table in the same buckets
    without moving rows; it is then written as it lies.

    Joins on ``by`` and other columns leave the table where it is in sessions with the setting
    below only, so it is made here for sessions that ``build_session`` didn't build.
    """
    spark = df.sparkSession
    spark.conf.set(CO_PARTITION, "false")
    n = buckets_for(spark, about)
    key = uuid.uuid4().hex
    (df if in_place else df.repartition(n, by)).write.bucketBy(n, by).sortBy(by, *sort) \
        .option("path", f"{run_folder(spark)}/{name}-{key}").saveAsTable(f"{TABLE}{name}_{key}")
    return spark.table(f"{TABLE}{name}_{key}")
