"""Pairing records with the nearest record in time of the same entity, by tick expansion.

Time is cut into ticks. Right records are first reduced to one for each entity and instant, then expanded to
every tick that their tolerance reaches. Of all right records that reach an (entity, tick), only those that
can be nearest to some instant of the tick are kept: the last before it, the first after it, and those inside
it (at most one for each millisecond, so bounded by the tick's length). Left records then meet exactly one row
by an equi-join on (entity, tick). A hot entity is spread over its ticks, so no task holds all of one entity.

Defined results: rows with a null entity or time pair with nothing; ties go to the smaller right id; equal
times are at distance 0; empty inputs give an empty result; other columns are ignored, so clashing names do no
harm; repeated left rows each get their partner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TICK_MS = 1000


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_ms: int, tick_ms: int = TICK_MS) -> DataFrame:
    """(left_id, right_id, distance_ms): for each left row the nearest right row of its entity within the tolerance.

    left: columns entity, at (bigint, ms), left_id. right: entity, at, right_id. Left rows without a partner are left out.
    """
    L = left.select("entity", "at", "left_id").where(F.col("entity").isNotNull() & F.col("at").isNotNull())
    R = (
        right.select("entity", "at", "right_id")
        .where(F.col("entity").isNotNull() & F.col("at").isNotNull() & F.col("right_id").isNotNull())
        .groupBy("entity", "at")
        .agg(F.min("right_id").alias("right_id"))
    )
    tick = lambda c: F.floor(c / F.lit(tick_ms)).cast("bigint")
    one = F.struct(F.col("at"), F.col("right_id"))
    reached = R.select(
        "entity", "at", "right_id", tick(F.col("at")).alias("own"),
        F.explode(F.sequence(tick(F.col("at") - tolerance_ms), tick(F.col("at") + tolerance_ms))).alias("tick"),
    )
    candidates = reached.groupBy("entity", "tick").agg(
        F.max(F.when(F.col("own") < F.col("tick"), one)).alias("before"),
        F.min(F.when(F.col("own") > F.col("tick"), one)).alias("after"),
        F.collect_list(F.when(F.col("own") == F.col("tick"), one)).alias("inside"),
    )
    paired = L.withColumn("tick", tick(F.col("at"))).join(
        candidates.withColumn("near", F.array_compact(F.concat("inside", F.array("before", "after")))).select("entity", "tick", "near"), ["entity", "tick"]
    )
    best = F.array_min(F.transform("near", lambda r: F.struct(F.abs(r["at"] - F.col("at")).alias("distance_ms"), r["right_id"].alias("right_id"))))
    return paired.select("left_id", best.alias("best")).select("left_id", "best.right_id", "best.distance_ms").where(F.col("distance_ms") <= tolerance_ms)
