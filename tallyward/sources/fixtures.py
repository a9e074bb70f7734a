"""Update, example and attack tables from the parquet tables, and generated uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import order_key
from ..operators.shaping import top_k

D, K = 64, 6
CLIENTS = 50
#: name, shape, buffer, first and end place in the flat vector
LAYOUT = (("layer_input.weight", [4, 12], False, 0, 48), ("layer_input.bias", [4], False, 48, 52), ("layer_hidden.weight", [3, 4], False, 52, 64), ("bn.running_mean", [4], True, 64, 68))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as the dense update of a client."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("client_id"), F.posexplode("embedding").alias("idx", "value"))
    return e.select(F.lit(1).cast("long").alias("fl_id"), F.lit(0).alias("round"), "client_id", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def sparse_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as uploads of suppliers, with repeated (client, index) cells."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.lit(1).cast("long").alias("fl_id"), F.lit(0).alias("round"), F.col("l_suppkey").alias("client_id"), F.col("l_partkey").alias("idx"), F.col("l_extendedprice").alias("value"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploads of daily rounds."""
    e = table(spark, sf_dir, "events")
    return e.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("round"), F.col("user_id").alias("client_id"), (F.col("event_id") % D).alias("idx"), "value", F.col("ts").cast("timestamp").alias("ts"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples, each owned by one of CLIENTS clients."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("example_id"), (F.col("vec_id") % CLIENTS).alias("client_id"), F.col("embedding").alias("features"), F.col("label").cast("long").alias("label"))


def attack_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """target(client_id, round, idx), teacher(label, round, idx) and truth(client_id, label)."""
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("label").cast("long").alias("label"))
    sets = top_k(dense_updates(spark, sf_dir), K).select("client_id", "idx").join(label, F.col("client_id") == F.col("v"))
    teacher = sets.where("v % 5 = 0").select("label", (F.col("v") % 3).alias("round"), "idx").distinct()
    target = sets.where("v % 5 <> 0").select((F.col("v") % CLIENTS).alias("client_id"), (F.col("v") % 3).alias("round"), "idx").distinct()
    truth = label.where("v % 5 <> 0").select((F.col("v") % CLIENTS).alias("client_id"), "label").distinct()
    return target, teacher, truth


def layout(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(LAYOUT)]
    return spark.createDataFrame(rows, "layer_pos int, name string, shape array<int>, is_buffer boolean, start long, end long")


def generated_uploads(spark: SparkSession, clients: int, d: int, k: int, seed: int = 13) -> DataFrame:
    """k of d indices for each client without replacement, value = index / 1000, made in parallel from the ids alone.

    Index j of a client is a permutation of 0..d-1 applied to j: multiplication by a number coprime to d and a shift
    drawn for the client, so nothing is sorted or held.
    """
    import math

    step = next(s for s in range(int(d * 0.618) | 1, 2 * d + 3) if math.gcd(s, d) == 1)
    ids = spark.range(clients * k).select((F.col("id") / k).cast("long").alias("client_id"), (F.col("id") % k).alias("j"))
    shift = F.conv(F.substring(order_key(seed, "client_id"), 1, 8), 16, 10).cast("long") % d
    idx = (F.col("j") * step + shift) % d
    return ids.select(F.lit(1).cast("long").alias("fl_id"), F.lit(0).alias("round"), "client_id", idx.alias("idx")).withColumn("value", (F.col("idx") * F.lit(0.001)).cast("float").cast("double"))


class Duck:
    """The same tables for the checking SQL."""

    F1 = f"f1 AS (SELECT vec_id AS client_id, i AS idx, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range({D})) AS i))"
    TOP = F1 + f", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY abs(value) DESC, idx) AS rank FROM f1) WHERE rank <= {K})"
    F2 = "f2 AS (SELECT l_suppkey AS client_id, l_partkey AS idx, l_extendedprice AS value FROM lineitem)"
    F3 = f"f3 AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS round, user_id AS client_id, event_id % {D} AS idx, value FROM events)"
    F4 = f"f4 AS (SELECT vec_id AS example_id, vec_id % {CLIENTS} AS client_id, label::BIGINT AS label FROM embeddings)"
    F5 = TOP + f""", sets AS (SELECT t.client_id AS v, idx, label::BIGINT AS label FROM top t JOIN embeddings e ON e.vec_id = t.client_id),
teacher AS (SELECT DISTINCT label, v % 3 AS round, idx FROM sets WHERE v % 5 = 0),
target AS (SELECT DISTINCT v % {CLIENTS} AS client_id, v % 3 AS round, idx FROM sets WHERE v % 5 <> 0),
truth AS (SELECT DISTINCT vec_id % {CLIENTS} AS client_id, label::BIGINT AS label FROM embeddings WHERE vec_id % 5 <> 0)"""
    LAYOUT = "layout AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {s}, {str(b).lower()}, {a}, {e})" for i, (n, s, b, a, e) in enumerate(LAYOUT)) + ") t(layer_pos, name, shape, is_buffer, start, stop))"
