"""Session helpers: building a local session and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of ours should have; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

_written: list[tuple[SparkSession, str]] = []
_frames = threading.local()


def local_session(app: str = "skein", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the command line."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"skein-shared-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there goes when the application ends, or the temporary() around it."""
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    frames = getattr(_frames, "stack", None)
    if frames:
        frames[-1].append((spark, path))
    else:
        if not _written:
            atexit.register(release_all)
        _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts lineage like checkpoint(), survives the loss of executors, and keeps the columnar
    format, so later reads prune columns. The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary() -> Iterator[None]:
    """What this thread materializes inside goes at the end, so that a server that runs for long keeps nothing."""
    if not hasattr(_frames, "stack"):
        _frames.stack = []
    _frames.stack.append([])
    try:
        yield
    finally:
        _delete(_frames.stack.pop())


def release_all() -> None:
    """Delete everything that was materialized outside temporary()."""
    _delete(_written)


def _delete(written: list[tuple[SparkSession, str]]) -> None:
    while written:
        spark, path = written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
