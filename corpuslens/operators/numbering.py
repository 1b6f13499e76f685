"""Numbers, running offsets and neighbours within groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned by group and order, so a
large group spreads over many partitions; each partition is worked on its own and corrected by one small row
per (group, partition) that stands for what lies before or after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from corpuslens.session import pin, scratch_path

PID, WEIGHT, BEFORE, HEAD = "_pid", "_weight", "_before_in_task", "_head_of_task"


def _columns(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranged(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """Range-partitioned by group and order, with the partition id as a column.

    The id depends on placement, so the frame is checkpointed before anything uses it twice.
    """
    keys = [*[F.col(g) for g in group], *_columns(order)]
    return pin(df.repartitionByRange(*keys).withColumn(PID, F.spark_partition_id()))


def offsets_on(frame: DataFrame, group: list[str], order: list, weight: str, out: str) -> DataFrame:
    """On a ranged frame: the sum of ``weight`` over the rows before this one in its group."""
    totals = frame.groupBy(*group, PID).agg(F.sum(weight).alias("_total"))
    ahead = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*group, PID, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_shift"))
    local = Window.partitionBy(*group, PID).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        frame.withColumn("_local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
        .join(shifts, [*group, PID])
        .withColumn(out, (F.col("_shift") + F.col("_local")).cast("bigint"))
        .drop("_local", "_shift")
    )


def neighbour_on(frame: DataFrame, group: list[str], order: list[str], value: str, out: str, step: int) -> DataFrame:
    """On a ranged frame: ``value`` of the previous (step -1) or next (step 1) row of the group, or NULL."""
    pick = F.max if step < 0 else F.min
    edges = frame.groupBy(*group, PID).agg(pick(F.struct(*order, F.col(value).alias("_v"))).alias("_edge"))
    across = Window.partitionBy(*group).orderBy(PID)
    side = edges.select(*group, PID, F.lag("_edge", -step).over(across)["_v"].alias("_outer"))
    local = Window.partitionBy(*group, PID).orderBy(*order)
    at_edge = F.row_number().over(local if step < 0 else Window.partitionBy(*group, PID).orderBy(*[F.col(c).desc() for c in order]))
    return (
        frame.withColumn("_inner", F.lag(value, -step).over(local))
        .withColumn("_at", at_edge)
        .join(side, [*group, PID])
        .withColumn(out, F.when(F.col("_at") == 1, F.col("_outer")).otherwise(F.col("_inner")))
        .drop("_inner", "_outer", "_at")
    )


def _runs(rows: DataFrame, group: list[str], weight: str) -> DataFrame:
    """On rows that lie sorted by group in their tasks: ``BEFORE``, the sum of ``weight`` over the rows before this one of its
    group in this task, and ``HEAD``, whether this is the task's first group."""
    places, at = [rows.columns.index(g) for g in group], rows.columns.index(weight)
    names = [*rows.columns, BEFORE, HEAD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, seen = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = np.zeros(batch.num_rows, bool)
            for k in places:
                column = batch.column(k)
                opens[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            opens[0] = last != [batch.column(k)[0].as_py() for k in places]
            last = [batch.column(k)[-1].as_py() for k in places]
            weights = pc.fill_null(batch.column(at), 0).to_numpy()
            ahead = np.cumsum(weights) - weights
            start = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), -1))
            before = ahead - np.where(start < 0, -carry, ahead[np.maximum(start, 0)])
            run_no = seen + np.cumsum(opens)
            carry, seen = int(before[-1] + weights[-1]), int(run_no[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(run_no == 1)], names=names)

    schema = StructType([*rows.schema.fields, StructField(BEFORE, LongType()), StructField(HEAD, BooleanType())])
    return rows.mapInArrow(run, schema)


def _running(df: DataFrame, group: list[str], order: list, weight: str, out: str) -> DataFrame:
    """``df`` with the sum of its bigint column ``weight`` over the rows before a row in its group.

    Rows are exchanged once, by ranges, sorted and written with the sum within their task. Only a task's first group can
    have rows in the tasks before it: one small row for each task corrects that, so no row is exchanged again and what is
    broadcast grows with the tasks, not with the groups. Rows without a group are left out.
    """
    keys = [*[F.col(g) for g in group], *_columns(order)]
    path = scratch_path(df.sparkSession, "numbered")
    given = df.dropna(subset=group)
    placed = _runs(given.repartitionByRange(*keys).sortWithinPartitions(*keys), group, weight).withColumn(PID, F.spark_partition_id())
    placed.write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    heads = rows.where(HEAD).select(*group).distinct()
    totals = rows.join(F.broadcast(heads), group, "left_semi").groupBy(*group, PID).agg(F.sum(weight).alias("_total"))
    ahead = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*group, PID, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_shift")).where("_shift <> 0")
    return rows.join(F.broadcast(shifts), [*group, PID], "left").withColumn(out, F.col(BEFORE) + F.coalesce("_shift", F.lit(0)))


def offsets_within(df: DataFrame, group: list[str], order: list, weight: str, out: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows before this one in its group. ``order`` must be unique."""
    given = df.withColumn(WEIGHT, F.col(weight).cast("bigint"))
    return _running(given, group, order, WEIGHT, out).select(*df.columns, out)


def number_within(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """Adds 1..n per group in ``order``, which must be unique within the group."""
    numbered = _running(df.withColumn(WEIGHT, F.lit(1).cast("bigint")), group, order, WEIGHT, out)
    return numbered.withColumn(out, F.col(out) + 1).select(*df.columns, out)
