import pytest
from pyspark.sql import functions as F

from tallyward import catalogue
from tallyward.sources import fixtures as fx


@pytest.mark.parametrize("name", ["seeded_order", "flatten_layers", "l2_projection"])
def test_all_clients_and_indices(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    assert got.select("client_id", "idx").distinct().count() == fx.dense_updates(spark, sf).count()


def test_all_rounds_and_indices(spark, sf):
    got = catalogue.QUERIES["round_mean_from_events"](spark, sf)
    rounds = fx.rounds(spark, sf).select("round").distinct().count()
    assert rounds > 1 and got.groupBy("round").agg(F.count_distinct("idx").alias("n")).where(f"n = {fx.D}").count() == rounds
