"""Aggregation of sparse and dense updates into the dense mean vector.

One core (a sum by index over the uploads and a zero for every index, in a single shuffle with partial sums) and the
other physical shapes, all with the same result: indices outside 0..d-1 are left out, repeated cells add up, missing
indices are 0, and the mean multiplies by 1/n, n being the size of the roster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import micro, order_key
from ..model import ALGORITHMS


def _value(exact: bool):
    return micro("value") if exact else F.col("value").cast("double")


def _unit(exact: bool) -> float:
    return 1e6 if exact else 1.0


def in_range(updates: DataFrame, d: int) -> DataFrame:
    return updates.where((F.col("idx") >= 0) & (F.col("idx") < d))


def cells(updates: DataFrame, d: int, exact: bool) -> DataFrame:
    """(idx, s): what there is to add up, with a zero for every index."""
    zeros = updates.sparkSession.range(d).select(F.col("id").alias("idx"), F.lit(0).cast("long" if exact else "double").alias("s"))
    return in_range(updates, d).select("idx", _value(exact).alias("s")).unionByName(zeros)


def summed(updates: DataFrame, d: int, exact: bool = False) -> DataFrame:
    return cells(updates, d, exact).groupBy("idx").agg(F.sum("s").alias("s"))


def batched(updates: DataFrame, d: int, batch: int, exact: bool = False) -> DataFrame:
    """Sums of batches of clients, then of all batches."""
    rows = in_range(updates, d).select((F.col("client_id") / batch).cast("long").alias("batch_no"), "idx", _value(exact).alias("s"))
    zeros = cells(updates.limit(0), d, exact).select(F.lit(-1).cast("long").alias("batch_no"), "idx", "s")
    per_batch = rows.unionByName(zeros).groupBy("batch_no", "idx").agg(F.sum("s").alias("s"))
    return per_batch.groupBy("idx").agg(F.sum("s").alias("s"))


def folded(updates: DataFrame, d: int, exact: bool = False, runs: int = 64) -> DataFrame:
    """Sort by index, carry the running sum, keep the last row of each index.

    Cells of an index are summed in a bounded number of runs first, before the shuffle as well, so a hot index doesn't
    gather its cells in one task.
    """
    rows = cells(updates, d, exact).groupBy("idx", F.pmod(F.xxhash64("s"), F.lit(runs)).alias("run")).agg(F.sum("s").alias("s"))
    fold = Window.partitionBy("idx").orderBy("run")
    rows = rows.withColumn("after", F.lead("s").over(fold)).withColumn("s", F.sum("s").over(fold.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("after").isNull()).select("idx", "s")


def by_cache_line(updates: DataFrame, d: int, width: int = 16, exact: bool = False) -> DataFrame:
    """Cells matched within lines of ``width`` indices: one row of sums for a line, opened up again."""
    rows = cells(updates, d, exact).groupBy((F.col("idx") / width).cast("long").alias("line"))
    wide = rows.agg(*[F.sum(F.when(F.col("idx") % width == j, F.col("s"))).alias(f"s{j}") for j in range(width)])
    slots = F.posexplode(F.array(*[f"s{j}" for j in range(width)])).alias("j", "s")
    return wide.select("line", slots).select((F.col("line") * width + F.col("j")).alias("idx"), "s").where(F.col("idx") < d)


def shuffled(updates: DataFrame, d: int, dummies: DataFrame | None = None, seed: int = 100, exact: bool = False) -> DataFrame:
    """With dummies (idx, value 0) mixed in and rows dealt out by a hash, then the guarded sum."""
    rows = updates.select("idx", "value")
    if dummies is not None:
        rows = rows.unionByName(dummies.select("idx", F.lit(0.0).alias("value")))
    return summed(rows.repartition(order_key(seed, "idx", "value")), d, exact)


def padded(rows: DataFrame, seed_value: int = 2**32 - 1) -> DataFrame:
    """Rows (idx, value) filled up to a power of two with cells that no vector has."""
    n = rows.count()
    size = 1 << max(0, n - 1).bit_length()
    extra = rows.sparkSession.range(max(0, size - n)).select(F.lit(seed_value).cast("long").alias("idx"), F.lit(0.0).alias("value"))
    return rows.select("idx", "value").unionByName(extra)


def aggregated(updates: DataFrame, d: int, hint: str = "non_oblivious", batch: int = 100, dummies: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(idx, s), the sum of each index, in the shape that the hint names."""
    if hint not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {hint!r}")
    if hint == "optimized":
        return batched(updates, d, batch, exact)
    if hint in ("advanced", "bubble"):
        return folded(updates, d, exact)
    if hint == "baseline":
        return by_cache_line(updates, d, exact=exact)
    if hint == "nips19":
        return shuffled(updates, d, dummies, exact=exact)
    return summed(updates, d, exact)


def mean(updates: DataFrame, n: int, d: int, hint: str = "non_oblivious", batch: int = 100, dummies: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(idx, value): the dense mean over a roster of n."""
    s = aggregated(updates, d, hint, batch, dummies, exact)
    return s.select("idx", (F.col("s") * F.lit(1.0 / n) / F.lit(_unit(exact))).alias("value"))


def round_means(updates: DataFrame, d: int, exact: bool = False) -> DataFrame:
    """(round, idx, value): the dense mean of each round over the clients that sent anything in it."""
    n = updates.groupBy("round").agg(F.count_distinct("client_id").alias("n"))
    zeros = n.select("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d - 1).cast("long"))).alias("idx"), F.lit(0).cast("long" if exact else "double").alias("s"))
    s = in_range(updates, d).select("round", "idx", _value(exact).alias("s")).unionByName(zeros).groupBy("round", "idx").agg(F.sum("s").alias("s"))
    return s.join(n, "round").select("round", "idx", (F.col("s") * (F.lit(1.0) / F.col("n")) / F.lit(_unit(exact))).alias("value"))


def dense_mean(updates: DataFrame, exact: bool = False) -> DataFrame:
    """The mean of dense updates by index: over those who sent it."""
    s = updates.groupBy("idx").agg(F.sum(_value(exact)).alias("s"), F.count("*").alias("n"))
    return s.select("idx", (F.col("s") * (F.lit(1.0) / F.col("n")) / F.lit(_unit(exact))).alias("value"))


def applied(vector: DataFrame, update: DataFrame, rate: float = 1.0) -> DataFrame:
    """vector + rate * update, by index; an index that only one has counts as 0 in the other."""
    both = vector.select("idx", "value").unionByName(update.select("idx", (F.col("value") * rate).alias("value")))
    return both.groupBy("idx").agg(F.sum("value").alias("value"))


def index_counts(observations: DataFrame, keys: tuple[str, ...] = ("round",), least: int = 1) -> DataFrame:
    """How often each index of a round was sent, where at least so often."""
    return observations.groupBy(*keys, "idx").count().where(F.col("count") >= least)


def checksum(updates: DataFrame, n: int, d: int) -> DataFrame:
    """Sum of all cells over n against the sum of the mean vector."""
    sent = in_range(updates, d).agg((F.sum(micro("value")) / F.lit(1e6) / F.lit(float(n))).alias("sent"))
    held = summed(updates, d, True).agg((F.sum("s") / F.lit(1e6) / F.lit(float(n))).alias("held"))
    return sent.join(F.broadcast(held))  # one row by one row


def one_vs_one_votes(votes: DataFrame) -> DataFrame:
    """(client_id, label, votes) from the winners of pairwise decisions."""
    return votes.groupBy("client_id", F.col("winner").alias("label")).agg(F.count("*").alias("votes"))


def mean_of_means(metrics: DataFrame) -> DataFrame:
    """Batch values to means of epochs, of clients, of rounds."""
    epoch = metrics.groupBy("round", "client_id", "epoch").agg(F.avg("value").alias("value"))
    client = epoch.groupBy("round", "client_id").agg(F.avg("value").alias("value"))
    return client.groupBy("round").agg(F.avg("value").alias("value"))


def bench_summary(trials: DataFrame) -> DataFrame:
    """Mean times without the first trial, which warms up; null where that leaves none."""
    keys = ("algorithm", "num_of_parameters", "num_of_sparse_parameters", "num_of_clients")
    warm = lambda c: F.avg(F.when(F.col("trial") > 0, F.col(c))).alias(c)
    return trials.groupBy(*keys).agg(warm("load_s"), warm("decryption_s"), warm("aggregation_s"), warm("total_s"), F.count_if(F.col("trial") > 0).alias("trials"))
