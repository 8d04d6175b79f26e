"""Append-only streams: marks live in the state store, restarts and replays add nothing twice, and no batch reads the sink."""

import shutil

from pyspark.sql import functions as F

from quantloom.streaming import jobs

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def put(spark, folder, name, rows):
    df = spark.createDataFrame([(i, u, float(s)) for i, u, s in rows], "event_id long, user_id long, s double")
    df.select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), F.col("s").alias("value")).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(folder))


def stored(spark, out):
    return sorted((r["event_id"], r["user_id"]) for r in spark.read.parquet(out).collect())


def test_marks_survive_a_restart_and_a_replay(spark, tmp_path):
    out, feed = str(tmp_path / "out"), tmp_path / "feed"
    put(spark, tmp_path / "out", "batch=-1", [(1, 7, 1000), (2, 7, 2000), (3, 8, 1500)])
    put(spark, feed, "a", [(4, 7, 1500), (5, 7, 2000), (6, 7, 2500), (7, 7, 2200), (8, 9, 10), (9, 9, 5), (9, 9, 5)])
    jobs.append_only(stream(spark, feed), out)
    want = [(1, 7), (2, 7), (3, 8), (6, 7), (7, 7), (8, 9), (9, 9)]
    assert stored(spark, out) == want
    # a restart with new files goes on from the state: 2400 is not newer than 2500 any more, and key 9 has a mark of its own
    put(spark, feed, "b", [(10, 7, 2400), (11, 7, 2600), (12, 9, 8), (13, 9, 11), (14, 8, 1500), (15, 8, 1501)])
    jobs.append_only(stream(spark, feed), out)
    want = sorted([*want, (11, 7), (13, 9), (15, 8)])
    assert stored(spark, out) == want
    # the last batch is replayed: its commit is lost, its output is overwritten
    last = max(int(p.name) for p in (tmp_path / "out-checkpoint" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "out-checkpoint" / "commits" / str(last)).unlink()
    (tmp_path / "out-checkpoint" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    jobs.append_only(stream(spark, feed), out)
    assert stored(spark, out) == want


def test_no_batch_reads_the_sink(spark, tmp_path):
    out, feed = str(tmp_path / "out"), tmp_path / "feed"
    put(spark, tmp_path / "out", "batch=-1", [(1, 7, 1000)])
    put(spark, feed, "a", [(2, 7, 1100), (3, 7, 900)])
    jobs.append_only(stream(spark, feed), out)
    shutil.move(out, str(tmp_path / "elsewhere"))  # only the marks and the state are left
    (tmp_path / "out").mkdir()
    put(spark, tmp_path / "out", "batch=-1", [(0, 0, 0)])
    put(spark, feed, "b", [(4, 7, 1050), (5, 7, 1200)])
    jobs.append_only(stream(spark, feed), out)
    assert stored(spark, out) == [(0, 0), (5, 7)]
