"""Streams of arriving rows."""

from pyspark.sql import functions as F

from skein.streaming import tail

SCHEMA = "session_id string, entry_id string, received_at timestamp, kind string"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def write(spark, path, rows):
    spark.createDataFrame(rows, "session_id string, entry_id string, t bigint, kind string").withColumn("received_at", F.timestamp_seconds("t")).drop("t").select("session_id", "entry_id", "received_at", "kind").coalesce(1).write.mode("append").parquet(path)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("S", "e", 1000, "a"), (" s ", "E", 1010, "a"), ("s", None, 1020, "b"), ("s", None, 1020, "b")])
    write(spark, path, [("s", "e", 1500, "a"), ("t", "x", 90_000, "b")])
    stream = tail.follow(spark, path, SCHEMA, 1)
    assert len(run(tail.deduplicated(stream), "once")) == 4
    got = run(tail.activity_by_window(stream, "received_at", "kind"), "counts", "complete")
    assert {(r.kind, r.n) for r in got} == {("a", 2), ("b", 2), ("a", 1), ("b", 1)}
    spells = run(tail.quiet_sessions(stream), "spells", "complete")
    assert sorted((r.session, r.n) for r in spells) == [("s", 5), ("t", 1)]
