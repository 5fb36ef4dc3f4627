"""Messages delivered more than once: keep one copy of each identifier.

1. Rows are cut into BUCKETS time buckets and, by the hash of their identifier, into slices whose number grows with the
   table, so a slice holds about SLICE_ROWS rows whatever the table's size. Before that shuffle every task sets aside
   what it has just seen in the same bucket (a cache of fixed size): a message delivered endlessly sends few rows to
   its slice, and what is set aside is spread evenly.
2. In a slice there is a Bloom filter for each time bucket, side by side: slot s holds one 32-bit word whose bit b says
   that bucket b has an identifier there, so one lookup tests an identifier against every bucket. A second plane says
   which slots a bucket filled at least twice. A row whose identifier shows in no other bucket and not twice in its own
   is new for certain and goes no further. The filters have 64 bits a row, so the share that passes them does not
   depend on the table's size.
3. The possible repeats are stored with the buckets they matched and verified exactly on the full identifier: inside
   their own bucket by one aggregation on (bucket, identifier), and what is first there against the storage of the
   matching buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

BUCKETS = 32
PROBES = 3
#: Rows of a slice: as many at most in large tables, and as few at least in small ones.
SLICE_ROWS, LEAST_ROWS = 1 << 20, 1 << 12
#: Slots of 32 bits for each row of a slice.
DENSITY = 2
#: Identifiers that a task remembers to set repeats aside.
RECENT = 1 << 16


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """PROBES slots of each 64-bit hash, by double hashing."""
    x = h.astype(np.uint64, copy=False)
    step = ((x >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B1)
    return [((x + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(PROBES)]


class Planes:
    """Bloom filters of all time buckets: once, and at least twice."""

    def __init__(self, slots: int):
        self.slots = slots
        self.once, self.twice = np.zeros(slots, np.uint32), np.zeros(slots, np.uint32)

    def add(self, h: np.ndarray, bucket: np.ndarray) -> None:
        for at in _slots(h, self.slots):
            codes, counts = np.unique(at * BUCKETS + bucket, return_counts=True)
            slot, bit = codes // BUCKETS, (np.uint32(1) << (codes % BUCKETS).astype(np.uint32))
            again = (counts > 1) | ((self.once[slot] & bit) > 0)
            np.bitwise_or.at(self.twice, slot[again], bit[again])
            np.bitwise_or.at(self.once, slot, bit)

    def matches(self, h: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(other buckets that may hold the identifier as bits, whether its own may hold it again)."""
        full = np.uint32(0xFFFFFFFF)
        once, twice = np.full(len(h), full), np.full(len(h), full)
        for at in _slots(h, self.slots):
            once &= self.once[at]
            twice &= self.twice[at]
        own = np.uint32(1) << bucket.astype(np.uint32)
        return once & ~own, (twice & own) > 0


def slots_for(rows: int, density: int = DENSITY) -> int:
    """Slots for so many rows, a power of two."""
    return 1 << max(6, (density * rows - 1).bit_length())


def slices_for(rows: int, cores: int) -> int:
    """So many slices that each has SLICE_ROWS rows at most, and that all cores have some in smaller tables."""
    return max(1, -(-rows // SLICE_ROWS), min(-(-rows // LEAST_ROWS), 2 * cores))


#: How a row comes to its slice: as it is, set aside as seen before, or only to say that its bucket has it twice.
NEW, ASIDE, TWICE = 0, 1, 2


def _set_aside(recent: int):
    """(h, bucket, ...) to (h, bucket, ..., how): repeats of what the task remembers are set aside, and said once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h, last_b, told = np.zeros(recent, np.int64), np.full(recent, -1, np.int8), np.zeros(recent, bool)
        for b in batches:
            if not b.num_rows:
                continue
            h, bucket = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int8)
            pairs = np.empty(len(h), [("h", np.int64), ("b", np.int8)])
            pairs["h"], pairs["b"] = h, bucket
            first = np.zeros(len(h), bool)
            _, at, where = np.unique(pairs, return_index=True, return_inverse=True)
            first[at] = True
            slot = (((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) + bucket.astype(np.int64) * 7919) % recent
            known = (last_h[slot] == h) & (last_b[slot] == bucket)
            again = known | ~first
            # one message a pair: where it is set aside for the first time since it is remembered
            tell = np.zeros(len(at), bool)
            tell[where[again]] = True
            tell &= ~(known[at] & told[slot[at]])
            how = np.where(again, ASIDE, NEW).astype(np.int8)
            names = [*b.schema.names, "how"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(how)], names)
            if tell.any():
                rows = pa.array(at[tell])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *[pa.nulls(len(rows), c.type) for c in b.columns[2:]], pa.array(np.full(len(rows), TWICE, np.int8))], names)
            # the last pair of a slot stays; whether it was told goes with it
            last_h[slot[at]], last_b[slot[at]], told[slot[at]] = h[at], bucket[at], tell | (known[at] & told[slot[at]])

    return run


def _screen(density: int):
    """A slice's rows to its possible repeats, with the other buckets that may hold them as bits; null for what was set aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held).combine_chunks()
        how = every["how"].to_numpy()
        h, bucket = every["h"].to_numpy(), every["bucket"].to_numpy().astype(np.int64)
        new, told = how == NEW, how == TWICE
        planes = Planes(slots_for(int(new.sum() + told.sum()), density))
        planes.add(h[new], bucket[new])
        for _ in range(2):
            planes.add(h[told], bucket[told])
        others, again = planes.matches(h, bucket)
        rows = np.flatnonzero((how == ASIDE) | (new & ((others > 0) | again)))
        mask = pa.array(others[rows].astype(np.int64), mask=how[rows] == ASIDE)
        out = every.drop_columns(["h", "how"]).take(pa.array(rows)).append_column("others", mask)
        yield from out.to_batches(max_chunksize=10_000)

    return run


def redelivered(df: DataFrame, keys: list[str], order: str, time: str, slice_rows: int = SLICE_ROWS, recent: int = RECENT, density: int = DENSITY) -> DataFrame:
    """(order): the rows that repeat an earlier row's keys, all but the one with the smallest order value.

    Rows with a null in any key have no identifier and are never repeats. order must be unique. A null time
    goes to the first bucket. An empty table gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(F.col(order).alias("__order"), *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(time).cast("timestamp").alias("__time"))
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    span = rows.agg(F.count("*"), F.unix_seconds(F.min("__time")), F.unix_seconds(F.max("__time"))).first()
    n, first, last = span[0], span[1] or 0, span[2] or 0
    width = max(1, (last - first) // BUCKETS + 1)
    bucket = F.coalesce(F.floor((F.unix_seconds("__time") - first) / width), F.lit(0)).cast("int")
    keyed = rows.select(F.xxhash64(*names).alias("h"), bucket.alias("bucket"), "__order", *names)
    kinds = [(f.name, f.dataType.simpleString()) for f in keyed.schema.fields]
    marked = keyed.mapInArrow(_set_aside(recent), ", ".join(f"{a} {b}" for a, b in kinds) + ", how tinyint")
    slices = max(-(-n // slice_rows), slices_for(n, spark.sparkContext.defaultParallelism))
    # what was set aside is spread by its order value, all else meets its like
    sliced = marked.repartition(slices, F.when(F.col("how") == ASIDE, F.xxhash64("__order")).otherwise(F.col("h")))
    stored = materialize(sliced.mapInArrow(_screen(density), ", ".join(f"{a} {b}" for a, b in kinds[1:]) + ", others bigint"), "repeats")
    # one row a bucket and identifier; where all its rows were set aside under a hash that another identifier shares, any bucket may match
    storage = stored.groupBy("bucket", *names).agg(F.min("__order").alias("__order"), F.bit_or("others").alias("__others"))
    storage = materialize(storage.withColumn("__others", F.coalesce("__others", F.lit((1 << BUCKETS) - 1).cast("bigint"))), "storage")
    asked = storage.withColumn("__own", F.col("bucket")).withColumn("bucket", F.explode(F.filter(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.bit_get("__others", b) == 1))).where(F.col("bucket") != F.col("__own"))
    earlier = storage.select("bucket", *names, F.col("__order").alias("__first"))
    beaten = asked.join(earlier, ["bucket", *names]).where(F.col("__first") < F.col("__order")).select("__order").distinct()
    kept = storage.select("__order").join(beaten, "__order", "left_anti")
    # the order value is unique, so these joins have no hot key however often one message was delivered
    return stored.select("__order").join(kept, "__order", "left_anti").select(F.col("__order").alias(order))


def keep_first(df: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """df without the rows that redelivered() finds."""
    return df.join(redelivered(df, keys, order, time), order, "left_anti")
