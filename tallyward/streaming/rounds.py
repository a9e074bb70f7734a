"""Rounds over streams: running sums of each round, and a gate that lets only the current round of a job through."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.exact import micro

GATED = "fl_id long, round int, client_id long, idx long, value double, status string"


def round_sums(uploads: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(start, idx, s, cells): sums in millionths of each time window. In update (or append) mode, windows older than the
    latest event by ``lateness`` are let go, and rows for them dropped."""
    return uploads.withWatermark("ts", lateness).groupBy(F.window("ts", window), "idx").agg(F.sum(micro("value")).alias("s"), F.count("*").alias("cells")).select(F.col("window.start").alias("start"), "idx", "s", "cells")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/tallyward-stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str = "update", keys: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Runs over all that is there now, writes each micro-batch as Parquet, and reads what came out.

    keys: of rows that a later micro-batch replaces; the last one counts. A batch that is tried again replaces its own
    files, so nothing is there twice; no rows pass through the driver.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_no={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch_no=-1")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = spark.read.schema(f"{_ddl(stream)}, batch_no long").parquet(f"{folder}/out")
    if not keys:
        return out.drop("batch_no")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_no").alias("row")).select(*keys, "row.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of uploads."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client_id"), (F.col("event_id") % 64).alias("idx"), "value")


def statuses(rounds: np.ndarray, clients: np.ndarray, expected: int, now: int, heard: list[int]) -> tuple[list[str], int, list[int]]:
    """The status of each upload in turn, and the round and its clients after them.

    A round takes the first ``expected`` clients that send it; once it has them, the first upload of the next round begins
    that. Work is on whole arrays for each round that has rows, not for each upload.
    """
    order = np.argsort(rounds, kind="stable")
    of = rounds[order]
    at_round = lambda r: order[np.searchsorted(of, r) : np.searchsorted(of, r, "right")]
    began, fits, start = [], np.zeros(len(rounds), bool), 0
    while True:
        at = at_round(now)
        at = at[at >= start]
        ids, first = np.unique(clients[at], return_index=True)
        new = np.sort(first[~np.isin(ids, heard)])[: expected - len(heard)]
        heard = [*heard, *clients[at[new]].tolist()]
        fits[at] = np.isin(clients[at], heard)
        if len(heard) < expected:
            break
        closed = at[new[-1]] if len(new) else start - 1
        after = at_round(now + 1)
        after = after[after > closed]
        if not len(after):
            break
        start, now, heard = int(after[0]), now + 1, []
        began.append(start)
    current = now - len(began) + np.searchsorted(np.array(began, np.int64), np.arange(len(rounds)), "right")
    kinds = np.where(rounds < current, 0, np.where(rounds > current, 1, np.where(fits, 3, 2)))
    return np.array(["late_round", "early_round", "unknown_client", "ok"], object)[kinds].tolist(), now, heard


def gated(uploads: DataFrame, expected: int) -> DataFrame:
    """Adds status to each upload (with ts, its event time): a round is over once ``expected`` clients have sent it, and the next one begins.

    All that a micro-batch has of a job is put in the order of event times before anything is decided, so how Arrow
    cuts it has no part in it; one task holds that much of one job (bound it by the source's rows in a trigger).
    State for each job: its round and the clients heard so far, at most ``expected`` of them.
    """

    def step(key, frames, state: GroupState):
        now, heard = state.get if state.exists else (0, [])
        p = pd.concat(list(frames)).sort_values(["ts", "round", "client_id", "idx"], kind="stable")
        status, now, heard = statuses(p["round"].to_numpy(np.int64), p["client_id"].to_numpy(np.int64), expected, now, list(heard))
        state.update((now, [int(c) for c in heard]))
        yield p.assign(fl_id=key[0], status=status)[["fl_id", "round", "client_id", "idx", "value", "status"]]

    rows = uploads.select("fl_id", "ts", "round", "client_id", "idx", "value")
    return rows.groupBy("fl_id").applyInPandasWithState(step, GATED, "round int, heard array<long>", "append", GroupStateTimeout.NoTimeout)


def split_batches(stream: DataFrame, accepted: str, rejected: str, checkpoint: str):
    """Writes what passed and what didn't to two tables, a folder for each micro-batch, which a second try replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("status = 'ok'").drop("status").write.mode("overwrite").parquet(f"{accepted}/batch_no={number}")
        batch.where("status <> 'ok'").write.mode("overwrite").parquet(f"{rejected}/batch_no={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
