"""What the operators share: written tables with row ids, slices of Arrow batches by bytes,
objects kept per Python worker, and blocks of large buckets."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

ROW = "__row"
#: So many bytes of rows go to Python at a time, however long the rows are.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder with a row id that never changes afterwards.

    The id is given while writing, so equal rows, null ids and repeated ids are told apart,
    and a task that runs again reads the same ids back from the files.
    """
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def whole(text: Column) -> Column:
    """A text, empty where null."""
    return F.coalesce(text, F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str,
             most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``most`` bytes of ``column``.

    A slice always holds one row at least, so one long text makes a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def _kept() -> dict:
    return sys.__dict__.setdefault("_tripweave_kept", {})


def per_worker(key: tuple, make: Callable):
    """One object per Python worker process; tasks that follow in the process reuse it until
    one of them wants another, or none."""
    kept = _kept()
    if key not in kept:
        nothing_kept()
        kept[key] = make()
    return kept[key]


def nothing_kept() -> None:
    """Gives up what stages before have left in this worker; for tasks that need its memory.

    What is kept may refer to itself, as stores and their functions do; then only a collection
    frees it, and tasks on texts and numbers hardly ever come to one by themselves.
    """
    if _kept():
        _kept().clear()
        gc.collect()


def in_batches(rows: DataFrame, run: Callable, kinds) -> DataFrame:
    """``rows.mapInArrow(run, kinds)`` with batches bounded in bytes: by itself Spark counts rows
    only, and a task holds a batch several times over, in the executor and in Python."""
    rows.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(run, kinds)


def number_of_blocks(rows: Column, most: int) -> Column:
    """How many blocks of about ``most`` rows a bucket of ``rows`` rows is cut into."""
    return F.ceil(rows / F.lit(most)).cast("int")


def in_order(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 on within ``group`` by ``order``, and the
    group's ``total``.

    Sorted ranges are written down, each row with its place in the range; only the counts of a
    group's ranges meet in a window, so a group of any size is numbered by many tasks.
    """
    table = stored(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("__at", F.monotonically_increasing_id()), name)
    table = table.withColumn("__range", F.shiftright("__at", 33))
    ranges = table.groupBy(group, "__range").agg(F.min("__at").alias("first"),
                                                 F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(group)
    before = each.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(group, "__range", (F.coalesce(F.sum("n").over(before), F.lit(0))
                                              - F.col("first")).alias("__shift"),
                           F.sum("n").over(each).alias("total"))
    return (table.join(ranges, [group, "__range"])
            .withColumn("pos", F.col("__at") + F.col("__shift"))
            .drop("__at", "__range", "__shift"))


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed k0, k1, ... and the new name of each: whatever they
    are called, they clash with nothing an operator adds."""
    at = {c: f"k{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(k) for c, k in at.items())), at


def unmasked(df: DataFrame, at: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(k).alias(c) for c, k in at.items()))


def free(name: str, taken) -> str:
    """``name``, with underscores after it until no column is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once for a row however often it is used,
    also inside functions that run for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    """A struct; its names hold also inside functions of array elements."""
    return F.named_struct(*(x for n, c in fields.items() for x in (F.lit(n), c)))
