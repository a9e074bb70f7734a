"""Schemas, the configuration of a round, and the checks that requests must pass."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPDATES = "fl_id long, round int, client_id long, idx long, value double"
START = "fl_id long, client_ids array<long>, sigma float, clipping float, alpha float, sampling_ratio float, aggregation_alg int, num_of_parameters long, num_of_sparse_parameters long"
AGGREGATE = "fl_id long, round int, encrypted_parameters binary, num_of_parameters long, num_of_sparse_parameters long, optimal_num_of_clients long, aggregation_alg int, client_ids array<long>"
REPLY_START = "fl_id long, round int, client_ids array<long>"
REPLY_AGGREGATE = "updated_parameters array<float>, execution_time float, client_ids array<long>, round int"

# The codes of the aggregation algorithms on the wire.
ALGORITHMS = {
    "advanced": 1,
    "nips19": 2,
    "baseline": 3,
    "non_oblivious": 4,
    "path_oram": 5,
    "optimized": 6,
    "bubble": 7,
}
NAMES = {code: name for name, code in ALGORITHMS.items()}


def sample_size(clients: int, ratio: float) -> int:
    """Clients in a round: the product is taken in single precision and truncated."""
    as32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return int(as32(as32(clients) * as32(ratio)))


def sparse_size(d: int, alpha: float) -> int:
    """k of d coordinates, truncated."""
    return int(alpha * d)


@dataclass(frozen=True)
class RoundConfig:
    """One learning job. ``algorithm`` is a physical hint: all give the same result.

    Noise is added, and a privacy loss reported, only where ``noise`` is set.
    """

    fl_id: int
    num_of_parameters: int
    num_of_sparse_parameters: int
    clients: int
    sampling_ratio: float = 1.0
    algorithm: str = "non_oblivious"
    optimal_num_of_clients: int = 100
    sigma: float = 1.12
    clipping: float = 1.0
    alpha: float = 0.1
    delta: float = 1e-5
    noise: bool = False
    seed: int = 0

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if not 0 < self.sampling_ratio <= 1:
            raise ValueError("sampling_ratio must be in (0, 1]")
        if not 0 < self.num_of_sparse_parameters <= self.num_of_parameters:
            raise ValueError("num_of_sparse_parameters must be in 1..num_of_parameters")
        if self.noise and not (self.sigma > 0 and self.clipping > 0):
            raise ValueError("noise needs sigma and clipping above 0")
        if min(self.clients, self.optimal_num_of_clients) < 1:
            raise ValueError("at least one client is needed")

    @property
    def batch(self) -> int:
        """Clients in a batch of the batched algorithm: never more than there are."""
        return min(self.optimal_num_of_clients, max(1, self.sampled))

    @property
    def sampled(self) -> int:
        return sample_size(self.clients, self.sampling_ratio)


def checked(uploads: DataFrame, roster: DataFrame, current_round: int, d: int) -> DataFrame:
    """Adds status to each upload row: ok, or the first rule that it breaks. Nothing stops the job.

    A round other than the current one is late or early; a client must be on the roster; an index must be in 0..d-1;
    a value must be finite.
    """
    on = roster.select(F.col("client_id").alias("_on")).distinct()
    out = uploads.join(on, F.col("client_id") == F.col("_on"), "left")
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < math.inf)
    status = (
        F.when(F.col("round") < current_round, "late_round")
        .when(F.col("round") > current_round, "early_round")
        .when(F.col("_on").isNull(), "unknown_client")
        .when((F.col("idx") < 0) | (F.col("idx") >= d), "index_out_of_range")
        .when(~fine, "not_finite")
        .otherwise("ok")
    )
    return out.withColumn("status", status).drop("_on")


def same_clients(uploads: DataFrame, roster: DataFrame) -> bool:
    """Exact equality of both sets of clients (lengths and one direction alone would let duplicates through)."""
    a, b = uploads.select("client_id").distinct(), roster.select("client_id").distinct()
    return a.join(b, "client_id", "full_outer").count() == a.join(b, "client_id").count()


JOB = ("client_ids", "num_of_parameters", "num_of_sparse_parameters", "aggregation_alg")


def started(jobs: DataFrame | None, starts: DataFrame, order: str) -> DataFrame:
    """(fl_id, round, what a start says): jobs after start requests. The last start of a job by ``order`` replaces
    what was known of it and begins with round 0; other jobs stay as they are."""
    last = starts.groupBy("fl_id").agg(F.max_by(F.struct(*JOB), order).alias("job")).select("fl_id", F.lit(0).alias("round"), "job.*")
    if jobs is None:
        return last
    return jobs.join(last.select("fl_id"), "fl_id", "left_anti").select("fl_id", "round", *JOB).unionByName(last)


def requests_checked(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds status to aggregation requests: ok, or the first rule that one breaks. Nothing stops the job.

    requests: what AGGREGATE has, with the payload's length as bytes: 8 for each of a client's sparse cells.
    """
    j = jobs.select(*[F.col(c).alias(f"_{c}") for c in ("fl_id", "round", *JOB)])
    out = requests.join(j, F.col("fl_id") == F.col("_fl_id"), "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = (
        F.when(F.col("_fl_id").isNull(), "unknown_job")
        .when(F.col("round") < F.col("_round"), "late_round")
        .when(F.col("round") > F.col("_round"), "early_round")
        .when(differs("aggregation_alg"), "algorithm_mismatch")
        .when(differs("num_of_parameters") | differs("num_of_sparse_parameters"), "size_mismatch")
        .when(F.col("optimal_num_of_clients") > F.size("client_ids"), "batch_too_large")
        .when(~F.array_sort("client_ids").eqNullSafe(F.array_sort("_client_ids")), "roster_mismatch")
        .when(F.col("bytes") != F.size("client_ids") * F.col("num_of_sparse_parameters") * 8, "payload_mismatch")
        .otherwise("ok")
    )
    return out.withColumn("status", status).select(*requests.columns, "status")


def advanced(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Jobs with the next round where a request of theirs was ok."""
    done = seen.where("status = 'ok'").select(F.col("fl_id").alias("_done")).distinct()
    out = jobs.join(done, F.col("fl_id") == F.col("_done"), "left")
    return out.withColumn("round", F.col("round") + F.when(F.col("_done").isNotNull(), 1).otherwise(0)).drop("_done")
