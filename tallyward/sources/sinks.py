"""Result tables with fixed, named columns, and how they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BENCH = ("algorithm", "num_of_parameters", "num_of_sparse_parameters", "num_of_clients", "load_s", "decryption_s", "aggregation_s", "total_s")
# The columns of each kind of attack result. Counts change places between kinds, so rows go by name.
_SETTING = ("dataset", "epochs", "frac", "num_users", "num_of_label_k", "random_num_label", "model", "alpha", "attack", "fixed_inference_number", "single_model", "attacker_batch_size", "seed")
_NOISY = ("protection", "index_privacy_r", "dp", "epsilon", "delta")
ATTACK_KINDS = {
    "plain": (*_SETTING, "acc_all", "acc_top1", "num", "missing_labels"),
    "per_round": (*_SETTING, "acc_all", "acc_top1", "num", "missing_labels", "round"),
    "protected": (*_SETTING, *_NOISY, "acc_all", "acc_top1", "missing_labels", "num"),
}
ATTACK = ATTACK_KINDS["protected"]
UTILITY = ("dataset", "epochs", "num_users", "model", "seed", "accuracy", "losses")
TIMING = ("dataset", "num_users", "alpha", "algorithm", "optimal_num_of_clients", "execution_time")
METRICS = ("run", "step", "name", "value")


def shaped(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns by name in their fixed order, missing ones null, with the time of writing last."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns], F.current_timestamp().alias("timestamp"))


def write_results(df: DataFrame, path: str, columns: tuple[str, ...], append: bool = True, kind: str = "csv") -> None:
    """Appends (or replaces) rows; CSV has a header, arrays in it are JSON."""
    out = shaped(df, columns)
    if kind == "csv":
        out = out.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])
    writer = out.write.mode("append" if append else "overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def write_run(history: DataFrame, path: str, settings: dict) -> None:
    """A run's history (epoch, accuracy, loss, epsilon) with its settings beside every row, as a single JSON text."""
    import json

    out = shaped(history, ("epoch", "accuracy", "loss", "epsilon"))
    out.withColumn("settings", F.lit(json.dumps(settings, sort_keys=True, default=str))).write.mode("overwrite").parquet(path)


def bench_path(folder: str, algorithm: str, d: int, k: int, n: int, stamp: str, batch: int | None = None) -> str:
    return f"{folder}/{algorithm}{f'-{batch}' if batch is not None else ''}-{d}-{k}-{n}-{stamp}"


def cache_path(folder: str, config: dict, leave_out: tuple[str, ...] = ()) -> str:
    """Where a computed table is kept: by a digest of the configuration without what doesn't change it."""
    import hashlib
    import json

    kept = {k: v for k, v in sorted(config.items()) if k not in leave_out}
    return f"{folder}/{hashlib.md5(json.dumps(kept, default=str).encode()).hexdigest()}.parquet"


def cached(df_of, spark, path: str) -> DataFrame:
    """Reads the table if it is there, else computes and writes it first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        df_of().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)
