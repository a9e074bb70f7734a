import os

import numpy as np
from pyspark.sql import functions as F

from tallyward.streaming import rounds

SCHEMA = "fl_id long, ts timestamp, round int, client_id long, idx long, value double"


def plain(rows, expected):
    """The gate, an upload at a time: rows (round, client) in order."""
    now, heard, out = 0, [], []
    for r, c in rows:
        if r == now + 1 and len(heard) >= expected:
            now, heard = r, []
        if r != now:
            out.append("late_round" if r < now else "early_round")
        elif c in heard or len(heard) < expected:
            heard = heard if c in heard else [*heard, c]
            out.append("ok")
        else:
            out.append("unknown_client")
    return out


def test_statuses_are_those_of_one_at_a_time():
    rng = np.random.default_rng(9)
    for n, expected in ((0, 2), (1, 1), (40, 2), (300, 3), (300, 1)):
        r = np.sort(rng.integers(0, 6, n)) + rng.integers(-1, 2, n) if n else np.zeros(0, np.int64)
        r, c = np.maximum(r, 0), rng.integers(0, 5, n)
        want = plain(list(zip(r.tolist(), c.tolist())), expected)
        assert rounds.statuses(r, c, expected, 0, [])[0] == want
        half = n // 2  # in two micro-batches
        first, now, heard = rounds.statuses(r[:half], c[:half], expected, 0, [])
        assert first + rounds.statuses(r[half:], c[half:], expected, now, heard)[0] == want


def uploads(spark, path):
    rows = [(0, 1), (0, 2), (0, 3), (1, 1), (0, 1), (5, 1), (1, 2), (2, 9), (2, 8)]
    df = spark.createDataFrame([(1, i, r, c, i, 1.0) for i, (r, c) in enumerate(rows)], "fl_id long, s long, round int, client_id long, idx long, value double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).select("fl_id", "ts", "round", "client_id", "idx", "value")
    df.orderBy("client_id").coalesce(1).write.parquet(path)  # not in the order of their times
    return spark.readStream.schema(SCHEMA).parquet(path)


WANT = ["ok", "ok", "unknown_client", "ok", "late_round", "early_round", "ok", "ok", "ok"]


def test_gate(spark, tmp_path):
    stream = uploads(spark, str(tmp_path / "in"))
    for most in ("1", "10000"):  # rows in an Arrow chunk have no part in it
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = {r.idx: r.status for r in rounds.run_to_end(rounds.gated(stream, 2), "append").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert [got[i] for i in range(9)] == WANT
    query = rounds.split_batches(rounds.gated(stream, 2), str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == [i for i, s in enumerate(WANT) if s == "ok"]
    assert {r.idx: r.status for r in spark.read.parquet(str(tmp_path / "no")).collect()} == {i: s for i, s in enumerate(WANT) if s != "ok"}


def test_later_batches_replace_earlier_ones(spark, tmp_path):
    """Windows that two micro-batches add to are there once, with the last sum; what is too late is dropped."""
    day = 86_400
    parts = [[(0, 1.0), (1, 2.0)], [(1, 3.0), (10, 4.0)], [(10, 5.0)], [(0, 100.0)]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(d * day + i, v) for d, v in part], "s long, value double")
        df.select(F.timestamp_seconds("s").alias("ts"), F.lit(0).cast("long").alias("idx"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").iterdir():  # read in this order
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    stream = spark.readStream.schema("ts timestamp, idx long, value double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = rounds.run_to_end(rounds.round_sums(stream), keys=("start", "idx"))
    got = {r.start.timestamp() / day: (r.s / 1e6, r.cells) for r in out.collect()}
    assert out.count() == len(got) and got[1.0] == (5.0, 2) and got[10.0] == (9.0, 2) and got[0.0] == (1.0, 1)


def test_nothing_to_read(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert rounds.run_to_end(rounds.gated(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 2), "append").count() == 0
