"""As-of matching by key as a distributed scan: the last value at or before each row.

Rows are range-partitioned by (key, order), so a hot key spans many tasks. Every task fills forward in one
streaming pass and reports what it ends with; one small row a task reaches the driver, which works out what
each task should have begun with. A window over the key would hold a hot key in one task instead.

Defined results: a null key matches nothing; rows with equal order values are taken in the order of the tie
columns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize


def fill_forward(df: DataFrame, key: str, order: list[str], value: str, row: str) -> DataFrame:
    """(row, filled): for each row the last non-null value (bigint) of its key at or before it in the given order.

    key: string; row: bigint. Rows that carry a value are filled with their own.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("bigint").alias("v"), F.col(row).cast("bigint").alias("r"))
    by = ["k", *[f"o{i}" for i in range(len(order))]]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("k", "v", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carried, first = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode()
            codes, names = keys.indices.to_numpy(), keys.dictionary
            v, has = b.column(1).fill_null(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            n = len(codes)
            new = np.r_[True, codes[1:] != codes[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            at = np.maximum.accumulate(np.where(has, np.arange(n), -1))
            found = at >= start
            filled = np.where(found, v[np.maximum(at, 0)], 0)
            head = names[int(codes[0])].as_py()
            if first is None:
                first = head
            if last == head and carried is not None:  # goes on from the batch before
                open_ = (start == 0) & ~found
                filled, found = np.where(open_, carried, filled), found | open_
            last, carried = names[int(codes[-1])].as_py(), (int(filled[-1]) if found[-1] else None)
            in_first = codes == codes[0] if head == first else np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays(
                [b.column(2), pa.array(filled, mask=~found), pa.array(np.full(n, pid, np.int32)), pa.array(in_first & ~found), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
                ["r", "filled", "pid", "waits", "first", "last"],
            )
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([carried], pa.int64()), pa.array([pid], pa.int32()), pa.array([False]), pa.array([first]), pa.array([last])],
                ["r", "filled", "pid", "waits", "first", "last"],
            )

    done = materialize(ordered.mapInArrow(run, "r bigint, filled bigint, pid int, waits boolean, first string, last string"), "filled")
    # at most one row a task: bounded by the number of partitions
    ends = sorted(done.where(F.col("last").isNotNull()).select("pid", "first", "last", "filled").collect())
    brought, key_now, value_now = {}, None, None
    for pid, first, last, filled in ends:
        if first == key_now and value_now is not None:
            brought[pid] = value_now
        if filled is not None or last != key_now:
            key_now, value_now = last, filled
    out = done.where(F.col("r").isNotNull())
    if brought:
        lookup = F.broadcast(spark.createDataFrame(list(brought.items()), "pid int, __in bigint"))
        out = out.join(lookup, "pid", "left").withColumn("filled", F.when(F.col("waits"), F.col("__in")).otherwise(F.col("filled")))
    return out.select(F.col("r").alias(row), "filled")
