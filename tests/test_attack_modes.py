import numpy as np
import pytest

from tallyward.operators import learn, privacy, sampling, shaping, similarity


@pytest.mark.parametrize("hidden", [5, (6, 4), (5, 4, 3)])
def test_gradients_of_any_depth(hidden):
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (7, 4)), rng.integers(0, 3, 7)
    m = learn.Mlp(4, hidden, 3, seed=2)
    m.flat += rng.normal(0, 0.1, m.size)
    loss = lambda: -m.log_probabilities(x)[np.arange(7), y].mean()
    g = m.gradient(x, y)
    for i in rng.choice(m.size, 15, replace=False):
        m.flat[i] += 1e-6
        up = loss()
        m.flat[i] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[i], abs=1e-5)
        m.flat[i] += 1e-6


@pytest.fixture(scope="module")
def tables(spark):
    """Each label has its own indices; client c holds label c, and misses a round."""
    teacher = [(label, r, b, 6 * label + (r + b + k) % 6) for label in range(4) for r in range(3) for b in range(3 - (r == 2)) for k in range(4)]
    target = [(c, r, 6 * c + (r + k) % 6) for c in range(4) for r in range(3) if r != c for k in range(4)]
    return spark.createDataFrame(target, "client_id long, round long, idx long"), spark.createDataFrame(teacher, "label long, round long, batch_no int, idx long")


@pytest.mark.parametrize("mode", ["rounds", "single"])
def test_networks_tell_the_labels(tables, mode):
    target, teacher = tables
    for t in (teacher, teacher.where("batch_no = 0").drop("batch_no")):
        got = similarity.top_labels(learn.attack_scores(target, t, 24, 4, rounds=3, mode=mode), 1).collect()
        assert {r.client_id: r.label for r in got} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_networks_of_prefixes(tables):
    target, teacher = tables
    got = similarity.top_labels(learn.attack_scores(target, teacher, 24, 4, rounds=3, mode="prefixes"), 1, ("client_id", "upto")).collect()
    assert {(r.client_id, r.upto) for r in got} == {(c, u) for c in range(4) for u in range(3) if (c, u) != (0, 0)}
    assert all(r.client_id == r.label for r in got)
    with pytest.raises(ValueError):
        learn.attack_scores(target, teacher, 24, 4, mode="single")
    with pytest.raises(ValueError):
        learn.attack_scores(target, teacher, 24, 4, rounds=3, mode="other")


def test_single_model_by_name(tables):
    target, teacher = tables
    chosen, top = similarity.infer(target, teacher, "nn_single", 1, 24, 4, 3)
    assert {(r.client_id, r.label) for r in chosen.collect()} == {(r.client_id, r.label) for r in top.collect()} == {(i, i) for i in range(4)}


def test_batches_that_every_round_has(tables):
    _, teacher = tables
    assert {r.batch_no for r in shaping.one_batch_apart(teacher).collect()} == {0, 1}


def test_permutation_steps():
    for d in (1, 2, 6, 64, 997, 50_890):
        for s in privacy.permutation_steps(d):
            assert len({j * s % d for j in range(d)}) == d


def test_added_indices_are_other_ones(spark):
    rows = [(c, (7 * c + 3 * k) % 40) for c in range(6) for k in range(12)] + [(9, i) for i in range(40)] + [(10, i) for i in range(38)]
    got = {}
    for r in privacy.index_privacy(spark.createDataFrame(rows, "client_id long, idx long"), 40, 0.5, "s").collect():
        got.setdefault((r.client_id, r.real), []).append(r.idx)
    for c in range(6):
        real, more = got[c, True], got[c, False]
        assert len(more) == len(set(more)) == len(real) // 2 and not set(real) & set(more)
    assert (9, False) not in got and sorted(got[10, False]) == [38, 39]  # no more than there are


def test_multi_hot_of_odd_sets(spark):
    df = spark.createDataFrame([([],), ([0, 0, 4],), ([4],), ([0, 1, 2, 3, 4],), ([-1, 2, 9],)], "s array<long>")
    assert [r[0] for r in df.select(shaping.multi_hot(df.s, 5)).collect()] == [[0] * 5, [1, 0, 0, 0, 1], [0, 0, 0, 0, 1], [1] * 5, [0, 0, 1, 0, 0]]


def test_a_prepared_split_stays(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS example_id", "id % 4 AS label")
    folder = str(tmp_path / "split")
    sampling.prepared(df, 40, 0.5, folder, 1)
    first = sorted(map(tuple, sampling.loaded(spark, folder, 40, 0.5).collect()))
    sampling.prepared(df, 40, 0.5, folder, 2)
    assert sorted(map(tuple, sampling.loaded(spark, folder, 40, 0.5).collect())) == first and len(first) == 60
    assert len([r for r in sampling.loaded(spark, folder, 40, 0.1).collect() if r.part == "test"]) == 4
    with pytest.raises(ValueError):
        sampling.prepared(df, 90, 0.5, str(tmp_path / "other"), 1)
