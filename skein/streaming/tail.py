"""Structured Streaming over arriving messages and events.

Replacement of changed files stays a batch (skein.sources.store); these queries follow rows that only arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.keys import norm_id


def follow(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """The first delivery of each (session, entry) within the watermark; state older than that is dropped.

    messages: session_id, entry_id, received_at and others. Rows without either id are kept.
    """
    keyed = messages.withColumn("__s", F.coalesce(norm_id("session_id"), F.concat(F.lit("\u0000"), F.expr("uuid()"))))
    keyed = keyed.withColumn("__e", F.coalesce(norm_id("entry_id"), F.concat(F.lit("\u0000"), F.expr("uuid()"))))
    return keyed.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["__s", "__e"]).drop("__s", "__e")


def activity_by_window(events: DataFrame, time: str, kind: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, kind, n): rows by kind in tumbling or sliding windows; windows close when the watermark has passed them."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def quiet_sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session, start, end, n): spells of a session's messages without a gap of the given length."""
    s = messages.withColumn("session", norm_id("session_id")).where(F.col("session").isNotNull()).withWatermark("received_at", late)
    return s.groupBy("session", F.session_window("received_at", gap).alias("w")).agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
