import struct

import pytest
from pyspark.sql import functions as F

from tallyward.functions import codec
from tallyward.model import ALGORITHMS, UPDATES, RoundConfig, checked, same_clients, sample_size
from tallyward.operators import aggregate, privacy, sampling, shaping, similarity
from tallyward.plans import rounds
from tallyward.sources import sinks


@pytest.fixture(scope="module")
def uploads(spark):
    rows = [(1, 0, 1, 0, 1.0), (1, 0, 1, 0, 2.0), (1, 0, 1, 3, -4.0), (1, 0, 2, 3, 0.5), (1, 0, 2, 9, 7.0), (1, 0, 3, 1, 3.0)]
    return spark.createDataFrame(rows, UPDATES)


@pytest.mark.parametrize("hint", ALGORITHMS)
def test_all_algorithms_agree(uploads, hint):
    for exact in (False, True):
        got = {r.idx: r.value for r in aggregate.mean(uploads, 4, 5, hint, batch=2, exact=exact).collect()}
        assert got == {0: 0.75, 1: 0.75, 2: 0.0, 3: -0.875, 4: 0.0}


def test_unknown_algorithm(uploads):
    with pytest.raises(ValueError):
        aggregate.aggregated(uploads, 5, "none")


def test_one_shuffle(uploads):
    plan = aggregate.mean(uploads, 4, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_padding(uploads):
    assert aggregate.padded(uploads).count() == 8


def test_top_k_ties_and_clip(spark):
    u = spark.createDataFrame([(1, 0, 1, i, v) for i, v in enumerate((1.0, -3.0, 3.0, 0.0))] + [(1, 0, 2, 0, 0.0)], UPDATES)
    assert [r.idx for r in shaping.top_k(u, 2).where("client_id = 1").orderBy("rank").collect()] == [1, 2]
    got = shaping.clipped(u, 1.0)
    assert got.where("client_id = 1").agg(F.sum(F.col("value") ** 2)).first()[0] == pytest.approx(1.0)
    assert got.where("client_id = 2").first().value == 0.0


def test_checks(spark, uploads):
    roster = spark.createDataFrame([(1,), (2,)], "client_id long")
    late = uploads.withColumn("round", F.when(F.col("value") == 2.0, -1).when(F.col("value") == 1.0, 1).otherwise(0))
    got = {(r.client_id, r.value): r.status for r in checked(late, roster, 0, 5).collect()}
    assert got == {(1, 1.0): "early_round", (1, 2.0): "late_round", (1, -4.0): "ok", (2, 0.5): "ok", (2, 7.0): "index_out_of_range", (3, 3.0): "unknown_client"}
    assert not same_clients(uploads, roster)
    assert same_clients(uploads.where("client_id < 3"), roster)


def test_config():
    assert sample_size(100, 0.3) == 30
    assert RoundConfig(1, 100, 10, 30, optimal_num_of_clients=100).batch == 30
    for bad in ({"algorithm": "x"}, {"sampling_ratio": 0.0}, {"clients": 0}, {"noise": True, "sigma": 0.0}):
        with pytest.raises(ValueError):
            RoundConfig(**({"fl_id": 1, "num_of_parameters": 100, "num_of_sparse_parameters": 10, "clients": 5} | bad))


def test_wire_format(spark):
    cells = [(0, 0.1), (2**32 - 1, -2.5), (7, 1e-42), (8, 0.0), (9, float("inf"))]
    df = spark.createDataFrame([(3, i, v) for i, v in cells], "client_id long, idx long, value double")
    sent = codec.encoded(df, ("client_id",))
    payload = bytes(sent.first().payload)
    assert payload == b"".join(struct.pack("<If", i, v) for i, v in sorted(cells))
    secret = sent.select("client_id", codec.crypted("payload", F.col("client_id")).alias("payload"))
    assert bytes(secret.first().payload) != payload
    back = codec.decoded(secret.select("client_id", codec.crypted("payload", F.col("client_id")).alias("payload")), ("client_id",))
    assert {(r.idx, r.value) for r in back.collect()} == {(i, struct.unpack("<f", struct.pack("<f", v))[0]) for i, v in cells}


def test_counter_mode_vector(spark):
    # NIST SP 800-38A, F.5.1.
    key, counter = "2b7e151628aed2a6abf7158809cf4f3c", 0xF0F1F2F3F4F5F6F7F8F9FAFBFCFDFEFF
    got = spark.range(1).select(F.hex(codec.keystream(F.unhex(F.lit(key)), F.lit(2).cast("long"), counter))).first()[0]
    assert got[:64] == "EC8CDF7398607CB0F2D21675EA9EA1E4362B7C3C6773516318A077D7FC5073AE"


def test_partitions(spark):
    ex = spark.range(103).select(F.col("id").alias("example_id"), (F.col("id") % 5).alias("label"))
    iid = sampling.iid(ex, 10, 1)
    assert iid.count() == 100 and iid.select("example_id").distinct().count() == 100
    assert {r["count"] for r in iid.groupBy("client_id").count().collect()} == {10}
    for owned in (sampling.noniid(ex, 7, 2, 3), sampling.noniid(ex, 7, 2, 3, vary=True)):
        assert owned.count() == owned.select("example_id").distinct().count() > 0
    assert sampling.unequal(ex, 4, 5, 2).select("example_id").distinct().count() == 103
    with pytest.raises(ValueError):
        sampling.stratified(ex, 3, 5, 1)
    assert sampling.fraction_of_clients(iid.select("client_id").distinct(), 0.01, 1, 10).count() == 1


def test_greedy_segments_never_overlap():
    got = sampling.deal_segments([(0, 10), (1, 23), (2, 7)], 6, 2, 9)
    seen = [(label, i) for _, label, first, n in got for i in range(first, first + n)]
    assert len(seen) == len(set(seen))


def test_two_means_and_metrics(spark):
    scores = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.12), (1, 2, 0.9), (1, 3, 0.8), (2, 0, 0.5), (2, 1, 0.5)], "client_id long, label long, score double")
    got = sorted((r.client_id, r.label) for r in similarity.upper_cluster(scores).collect())
    assert got == [(1, 2), (1, 3), (2, 0), (2, 1)]
    truth = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "client_id long, label long")
    m = similarity.attack_metrics(similarity.upper_cluster(scores), similarity.top_labels(scores), truth).first()
    assert (m.complete, m.hit, m.evaluated, m.missing, m.complete_share) == (1, 1, 2, 1, 1.0)


def test_empty_sets_have_no_jaccard(spark):
    e = F.array().cast("array<long>")
    assert spark.range(1).select(similarity.pair_jaccard(e, e)).first()[0] is None


def test_protections(spark):
    sets = spark.createDataFrame([(c, i) for c in range(6) for i in (c, 20, 21)], "client_id long, idx long")
    wide = privacy.index_privacy(sets, 64, 0.7, 1)
    assert {r["count"] for r in wide.groupBy("client_id").count().collect()} == {5}
    assert wide.groupBy("client_id", "idx").count().where("count > 1").count() == 0
    kept = privacy.k_anonymous(sets.withColumn("round", F.lit(0)))
    assert {r.idx for r in kept.collect()} == {20, 21}
    assert {r.idx for r in privacy.cache_lines(sets).collect()} == {0, 2}


def test_ldp_directions_are_unit(spark):
    g = spark.createDataFrame([(c, i, 0.1 * i) for c in range(5) for i in range(8)], "client_id long, idx long, value double")
    n = privacy.ldp_perturbed(g, 2.0, 1.0, 4).groupBy("client_id").agg(F.sum(F.col("value") ** 2).alias("q"))
    assert all(r.q == pytest.approx(1, abs=1e-4) for r in n.collect())
    assert privacy.ldp_constants(100, 1.0, 50)["c_eps"] == pytest.approx(2.163953, abs=1e-5)
    assert privacy.step_rate(0.1, 250) == 0.025


def test_rounds_over_a_folder(spark, tmp_path):
    clients = spark.range(4).withColumnRenamed("id", "client_id")
    start = spark.range(6).select(F.col("id").alias("idx"), F.lit(0.0).alias("value"))

    def updates(r, vector, members):
        cells = members.crossJoin(vector.select("idx"))
        return cells.select(F.lit(1).cast("long").alias("fl_id"), F.lit(r).alias("round"), "client_id", "idx", F.col("idx").cast("double").alias("value"))

    cfg = RoundConfig(1, 6, 2, 4)
    vector, spent = rounds.run_rounds(updates, clients, start, cfg, 2, str(tmp_path / "v"))
    assert {r.idx: r.value for r in vector.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 8.0, 5: 10.0} and spent is None
    noisy = RoundConfig(1, 6, 2, 4, noise=True, sampling_ratio=0.5)
    _, spent = rounds.run_rounds(updates, clients, start, noisy, 1, str(tmp_path / "w"))
    assert spent > 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("exp", 0.5, [0.1, 0.2])], "dataset string, accuracy double, losses array<double>")
    sinks.write_results(df, str(tmp_path / "u"), sinks.UTILITY)
    sinks.write_results(df, str(tmp_path / "u"), sinks.UTILITY)
    back = spark.read.option("header", True).csv(str(tmp_path / "u"))
    assert back.count() == 2 and back.columns == [*sinks.UTILITY, "timestamp"]
    path = sinks.cache_path(str(tmp_path), {"a": 1, "verbose": True}, ("verbose",))
    assert path == sinks.cache_path(str(tmp_path), {"a": 1, "verbose": False}, ("verbose",))
    made = []
    for _ in range(2):
        sinks.cached(lambda: made.append(1) or df, spark, path).collect()
    assert made == [1]
