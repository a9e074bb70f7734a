"""Whole rounds: sample clients, shape and check uploads, aggregate, apply, account, and choose the next roster."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import accounting
from ..model import RoundConfig, checked
from ..operators import aggregate, privacy, sampling, shaping


def roster(clients: DataFrame, cfg: RoundConfig, round_no: int) -> DataFrame:
    """The clients of a round."""
    return sampling.sampled_clients(clients.select("client_id").distinct(), cfg.sampled, f"{cfg.seed}|{cfg.fl_id}|{round_no}")


def run_round(updates: DataFrame, members: DataFrame, cfg: RoundConfig, round_no: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mean vector of the uploads that pass all checks, and those that don't with the reason."""
    seen = checked(updates, members, round_no, cfg.num_of_parameters)
    good = shaping.top_k(seen.where("status = 'ok'").drop("status"), cfg.num_of_sparse_parameters)
    if cfg.noise:
        good = shaping.clipped(good, cfg.clipping)
    n = max(1, cfg.sampled)
    out = aggregate.mean(good, n, cfg.num_of_parameters, cfg.algorithm, cfg.batch)
    if cfg.noise:
        out = privacy.gaussian(out, cfg.sigma, cfg.clipping, n, f"{cfg.seed}|{cfg.fl_id}|{round_no}")
    return out, seen.where("status <> 'ok'")


def run_rounds(updates_of, clients: DataFrame, start: DataFrame, cfg: RoundConfig, rounds: int, folder: str) -> tuple[DataFrame, float | None]:
    """The vector after some rounds, and the epsilon spent (null without noise), accounted for as what rosters are:
    samples of a fixed size without replacement.

    updates_of(round, vector, members) gives the uploads of a round. The vector is written to ``folder`` (which all
    executors must share) after each round, so lineage doesn't grow and a lost executor costs one round at most.
    """
    spark = start.sparkSession
    start.select("idx", "value").write.mode("overwrite").parquet(f"{folder}/0")
    vector = spark.read.parquet(f"{folder}/0")
    for r in range(rounds):
        members = roster(clients, cfg, r)
        update, _ = run_round(updates_of(r, vector, members), members, cfg, r)
        aggregate.applied(vector, update).write.mode("overwrite").parquet(f"{folder}/{r + 1}")
        vector = spark.read.parquet(f"{folder}/{r + 1}")
    if not cfg.noise:
        return vector, None
    spent, _ = accounting.epsilon(accounting.ORDERS, accounting.rdp_without_replacement(cfg.sampled / cfg.clients, cfg.sigma, rounds), cfg.delta)
    return vector, spent


def timed(updates: DataFrame, n: int, d: int, k: int, algorithms=("non_oblivious", "optimized", "baseline"), trials: int = 3) -> DataFrame:
    """Rows of aggregation times; trial 0 warms up."""
    rows = []
    for name in algorithms:
        for t in range(trials):
            began = time.perf_counter()
            aggregate.mean(updates, n, d, name).agg(F.sum("value")).collect()
            took = time.perf_counter() - began
            rows.append((name, d, k, n, 0.0, 0.0, took, took, t))
    return updates.sparkSession.createDataFrame(rows, "algorithm string, num_of_parameters long, num_of_sparse_parameters long, num_of_clients long, load_s double, decryption_s double, aggregation_s double, total_s double, trial int")
