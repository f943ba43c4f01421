"""Dense positions of rows in their groups, in a fixed order, without gathering a group in one task."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm.shared import stage


def sorted_rows(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows in ranges of (``group``, ``order``), sorted in each task; equal rows are split too, by where they were read.

    A group lies in consecutive tasks, as many as its size needs. ``df`` is read twice (its bounds are sampled).
    """
    salted = df.withColumn("_read", F.monotonically_increasing_id())
    keys = [group, *order, "_read"]
    return salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")


def run_starts(column: pa.Array, before) -> np.ndarray:
    """Where a new value begins in a sorted column without nulls; ``before`` is the value before it, or None."""
    starts = np.ones(len(column), bool)
    starts[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    starts[0] = column[0].as_py() != before
    return starts


def placed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``place``: from 0 in each group, ascending by ``order`` (nulls first); equal rows in any fixed order.

    ``group`` holds no nulls. Rows are numbered in the tasks that sorted them and written to the shared folder; what a task's
    first group has in earlier tasks is added afterwards. The driver sees two rows per task, whatever their size.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        value, count, first, held = None, 0, True, None

        def out(columns, last: bool) -> pa.RecordBatch:
            batch, local, opens = columns
            ends = np.zeros(len(batch), bool)
            ends[-1] = last
            parts = np.full(len(batch), part, np.int32)
            return pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (parts, local, opens, ends))],
                names=[*batch.schema.names, "_part", "_local", "_opens", "_ends"],
            )

        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield out(held, False)
            column = batch.column(group)
            starts = run_starts(column, value)
            at = np.arange(len(batch), dtype=np.int64)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            local = np.where(begin < 0, at + count, at - begin)
            changes = np.cumsum(starts) - (1 if first else 0)
            opens = (changes == 0) & (first or opens_still)
            opens_still = bool(opens[-1])
            value, count, first = column[len(batch) - 1].as_py(), int(local[-1]) + 1, False
            held = batch, local, opens
        if held is not None:
            yield out(held, True)

    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_local", T.LongType()),
            T.StructField("_opens", T.BooleanType()),
            T.StructField("_ends", T.BooleanType()),
        ]
    )
    rows = stage(sorted_rows(df, group, order).mapInArrow(number, schema), name)
    edges = rows.where(F.col("_ends") | (F.col("_opens") & (F.col("_local") == 0))).select(
        "_part", F.col(group).alias("value"), "_local", "_opens", "_ends"
    )
    starts, ends = {}, {}
    for r in edges.collect():  # two rows per task
        if r["_opens"] and r["_local"] == 0:
            starts[r["_part"]] = r["value"]
        if r["_ends"]:
            ends[r["_part"]] = r["value"], r["_local"] + 1, r["_opens"]
    earlier, value, tail = [], None, 0
    for part in sorted(starts):
        carry = tail if starts[part] == value else 0
        earlier.append((part, carry))
        value, tail, whole = ends[part]
        tail += carry if whole else 0
    if not any(n for _, n in earlier):
        place = F.col("_local")
    else:
        added = df.sparkSession.createDataFrame(earlier, "_part int, _earlier long")
        rows = rows.join(F.broadcast(added), "_part")  # one row per task
        place = F.col("_local") + F.when(F.col("_opens"), F.col("_earlier")).otherwise(0)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], place.alias("place"))
