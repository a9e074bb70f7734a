"""Requests and replies of a learning job as tables: JSON lines in, checked rows out, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AGGREGATE, REPLY_AGGREGATE, REPLY_START, START, requests_checked

SCHEMAS = {"start": START, "aggregate": AGGREGATE, "reply_start": REPLY_START, "reply_aggregate": REPLY_AGGREGATE}


def read(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """The messages of a kind under a path; fields that a message lacks are null, others are left out."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SCHEMAS[kind]).json(path)


def checked(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Aggregation requests with a status: see model.requests_checked."""
    return requests_checked(messages.withColumn("bytes", F.coalesce(F.length("encrypted_parameters"), F.lit(0))), jobs)


def replies(means: DataFrame, rosters: DataFrame, seconds: float) -> DataFrame:
    """What clients are told after a round: the dense vector, how long it took, and the next round's roster.

    means: (idx, value), one row for each index; rosters: (round, client_id) of the next round.
    """
    vector = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast("float").alias("value")))), lambda c: c["value"]).alias("updated_parameters"))
    roster = rosters.groupBy("round").agg(F.array_sort(F.collect_list("client_id")).alias("client_ids"))
    out = roster.join(F.broadcast(vector))  # one row
    return out.select("updated_parameters", F.lit(seconds).cast("float").alias("execution_time"), "client_ids", F.col("round").cast("int").alias("round"))
