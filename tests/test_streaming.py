"""Batch and stream give the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.operators import sequences as Q
from tallyforge.streaming import detectors as D

BASE = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, rows, chunks):
    path = str(tmp_path / "in")
    for i in range(chunks):
        part = spark.createDataFrame(rows[i::chunks] if chunks == 1 else rows[i * len(rows) // chunks : (i + 1) * len(rows) // chunks], "user string, ts timestamp, value double")
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("user string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(path)


def finish(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def rows():
    marks = [("a", s, float(v)) for s, v in [(0, 1), (8, 5), (17, 2), (39, 1), (60, 9), (61, 3)]] + [("b", s, 1.0) for s in range(0, 100, 7)]
    out = sorted(((u, BASE + dt.timedelta(seconds=s), v) for u, s, v in marks), key=lambda r: r[1])
    return out + [(u, BASE + dt.timedelta(hours=5), 0.0) for u in ("a", "b")] + [("z", BASE + dt.timedelta(hours=h), 0.0) for h in (20, 40)]


def test_nearby_and_skip(spark, tmp_path):
    data = spark.createDataFrame(rows(), "user string, ts timestamp, value double").withColumn("s", F.unix_seconds("ts")).where("user <> 'z'")
    want = {(r.user, r.s) for r in Q.keep_strongest_nearby(data, ["user"], "s", "value", 10).collect()}
    stream = feed(spark, tmp_path, rows(), 4)
    got = finish(D.keep_strongest_nearby(stream, "user", "ts", "value", "10 seconds"), "near", tmp_path).withColumn("s", F.unix_seconds("ts")).where("user <> 'z'")
    last = data.agg(F.max("s")).first()[0]
    assert {(r.user, r.s) for r in got.collect()} | {(u, last) for u in "ab"} == want
    want = {(r.user, r.s) for r in Q.suppress_after(data, ["user"], "s", 20).collect()}
    got = finish(D.suppress_after(stream, "user", "ts", "value", "20 seconds"), "skip", tmp_path).withColumn("s", F.unix_seconds("ts")).where("user <> 'z'")
    assert {(r.user, r.s) for r in got.collect()} == want


def test_sessions_and_revisions(spark, tmp_path):
    stream = feed(spark, tmp_path, rows(), 3)
    got = {(r.user, r.n) for r in finish(D.sessions(stream, "user", "ts", "30 seconds"), "sess", tmp_path).collect()}
    assert ("b", 15) in got and ("a", 6) in got
    sink = D.upsert_latest(str(tmp_path / "out"), "user", "value")
    for i, batch in enumerate([[("a", 1.0), ("b", 2.0)], [("a", 3.0), ("b", 1.0)]]):
        sink(spark.createDataFrame(batch, "user string, value double"), i)
    sink(spark.createDataFrame([("a", 3.0), ("b", 1.0)], "user string, value double"), 1)
    assert {(r.user, r.value) for r in D.latest(spark.read.parquet(str(tmp_path / "out")), "user", "value").collect()} == {("a", 3.0), ("b", 2.0)}
