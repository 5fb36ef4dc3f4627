"""References to records that do not exist.

References of all fields and the parents' keys are brought together by (field, key): both sides are hashed and
sorted the same way and merged linearly in one sort-merge join. Parents are first reduced to one validity
interval a key, so the merge meets one parent row at most and a hot key only makes the reference side long,
which AQE splits.

Status of a reference: 'present', 'late' (the parent exists but arrived after the reference), 'deleted' (every
row of the parent was removed) or 'missing' (no such parent, or no key to look for). Null times never make a
reference late. Repeated references are kept; an empty parent table makes every reference missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFERENCE = ("ref_field", "row_key", "key", "ref_at")
PARENT = ("ref_field", "key", "valid_from", "valid_to")


def validity(parents: DataFrame) -> DataFrame:
    """One interval a (ref_field, key): from the first arrival to the last removal; open if any row is still there."""
    return (
        parents.where(F.col("key").isNotNull())
        .groupBy("ref_field", "key")
        .agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("__last"), F.bool_or(F.col("valid_to").isNull()).alias("__open"))
        .select("ref_field", "key", "valid_from", F.when(~F.col("__open"), F.col("__last")).alias("valid_to"))
    )


def resolve(references: DataFrame, parents: DataFrame) -> DataFrame:
    """references with a column status. references: REFERENCE columns; parents: PARENT columns, several rows a key allowed."""
    # Keys that are null can't match; a key made of the row keeps them from meeting in one partition.
    refs = references.select(*REFERENCE).withColumn("__key", F.coalesce("key", F.concat(F.lit("\u0000"), F.col("row_key").cast("string"))))
    found = validity(parents).select("ref_field", F.col("key").alias("__key"), "valid_from", "valid_to", F.lit(True).alias("__there"))
    joined = refs.hint("merge").join(found, ["ref_field", "__key"], "left")
    status = (
        F.when(F.col("__there").isNull(), "missing")
        .when(F.col("valid_to").isNotNull(), "deleted")
        .when(F.col("valid_from") > F.col("ref_at"), "late")
        .otherwise("present")
    )
    return joined.select(*REFERENCE, status.alias("status"))


def report(resolved: DataFrame) -> DataFrame:
    """(ref_field, period, status, n): references of each field and UTC month by status."""
    return resolved.groupBy("ref_field", period("ref_at").alias("period"), "status").agg(F.count("*").alias("n"))


def period(col: str):
    """The UTC month 'YYYY-MM' of a timestamp, '' if null."""
    return F.coalesce(F.date_format(col, "yyyy-MM"), F.lit(""))
