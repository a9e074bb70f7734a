from itertools import combinations

import numpy as np
import pytest

from tallyward.llm import quality_rules
from tallyward.llm.quality_rules import FLOOR, P, UNIT


def table(spark, groups):
    """Rows of the groups' vectors."""
    rows = [(g, 100, 0, *[int(v) for v in np.rint(x * UNIT)]) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "grp string, n_words long, n_repeat_words long, " + ", ".join(f"x{i} long" for i in range(P)))


LEAST = np.diag(FLOOR**2)


def mixture(rng, n, bad):
    x = rng.normal(0, 1, (n, P)) @ rng.normal(0, 0.5, (P, P))
    x[:bad] += 6 + rng.normal(0, 0.1, (bad, P))
    return np.rint(np.clip(x, -15, 15) * UNIT) / UNIT


@pytest.mark.parametrize(("n", "h"), [(2, 2), (11, 7), (14, 9), (16, 11)])
def test_least_determinant_of_small_groups(n, h):
    """Against every part of h rows."""
    rng = np.random.default_rng(41 + n)
    for bad in (0, n // 8, n // 4):
        x = mixture(rng, n, bad)
        every = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + LEAST)[1] for c in combinations(range(n), h))
        assert quality_rules.least_part(x, h, LEAST)[1] == pytest.approx(every, abs=1e-9)


def test_distributed_steps_find_the_same_minimum(spark, monkeypatch):
    """Concentration over bins against the search in one task, on groups with and without outliers."""
    rng = np.random.default_rng(45)
    groups = {f"g{i}": mixture(rng, 700, bad) for i, bad in enumerate((0, 60, 200))}
    found, written = {}, quality_rules.base.written

    def watched(df, tag):
        out = written(df, tag)
        if tag == "least":
            found.update({r.grp: r.log_det for r in out.collect()})
        return out

    monkeypatch.setattr(quality_rules.base, "written", watched)
    assert quality_rules.estimate(table(spark, groups), 0.65, 20, 1, exact_rows=0).count() == 3
    for g, x in groups.items():
        assert found[g] <= quality_rules.least_part(x, 455, LEAST)[1] + 0.05


def test_a_step_reads_each_row_once(spark):
    """Three starts are measured where a row stands, no row is joined with models; the sums are those of joined rows."""
    rng = np.random.default_rng(46)
    used = table(spark, {f"g{i}": mixture(rng, 400, 40 * i) for i in range(3)}).repartition(3)
    model = quality_rules._start_models(used, 1).where("grp != 'g1' or start = 2")
    one, joined = quality_rules._moments(used, model, 3), quality_rules._moments(used, model, 3, limit=0)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(one) and "Join" in plan(joined)
    rows = lambda df: sorted(map(tuple, df.select(joined.columns).collect()))
    assert rows(one) == rows(joined) and sum(r[3] for r in rows(one)) == 400 * 7


@pytest.mark.parametrize("exact", [0, 2000])
def test_correlated_majorities_are_found(spark, exact):
    """Outliers that no coordinate shows by itself are told by the scatter of the majority; a start by axes alone may stay where they hide."""
    rng = np.random.default_rng(42)
    a = rng.normal(0, 1, (600, 1)) * np.ones((1, P)) + rng.normal(0, 0.05, (600, P))
    b = rng.normal(0, 1, (200, 1)) * np.where(np.arange(P) % 2, 1, -1) + rng.normal(0, 0.05, (200, P))
    model = quality_rules.estimate(table(spark, {"g": np.clip(np.vstack([a, b]), -15, 15)}), 0.65, 20, 100, exact).first()
    inner = np.zeros((P, P))
    for i in range(P):
        for j in range(i, P):
            inner[i, j] = inner[j, i] = model[f"p{i}_{j}"] / (1 if i == j else 2)
    mean = np.array([model[f"m{i}"] for i in range(P)])
    d2 = lambda x: np.einsum("ni,ij,nj->n", x - mean, inner, x - mean)
    far = np.abs(b[:, 0]) > 0.5
    assert (d2(a) < 40).mean() > 0.99 and (d2(b)[far] > 40).mean() > 0.95


@pytest.mark.parametrize("exact", [0, 2000])
def test_outliers_are_ignored(spark, exact):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, P))
    x[:100] += 9
    model = quality_rules.estimate(table(spark, {"g": x}), 0.65, 20, 50, exact).first()
    assert all(abs(model[f"m{i}"]) < 0.4 for i in range(P))
    assert all(0.5 < model[f"p{i}_{i}"] < 2 for i in range(P))


def test_models_agree_in_any_order(spark):
    """Sums are of whole numbers: rows in another order and other partitions give the same bits."""
    rng = np.random.default_rng(43)
    df = table(spark, {"a": rng.normal(0, 1, (300, P)), "b": rng.normal(1, 2, (200, P)).clip(-15, 15)})
    rows = lambda d: sorted(map(tuple, quality_rules.estimate(d, 0.65, 20, 100, 250).collect()))
    assert rows(df.coalesce(1)) == rows(df.orderBy("x1").repartition(7, "x0"))


@pytest.mark.parametrize("n", [1, 3, 20])
def test_few_rows_are_measured_widely(spark, n):
    """A table of a few clean documents keeps them, and each has a distance."""
    rng = np.random.default_rng(44)
    words = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) + "." * int(rng.random() < 0.1) for _ in range(120))
    docs = spark.createDataFrame([(i, words(), "en", "a") for i in range(n)], "doc_id long, text string, lang string, source string")
    got = quality_rules.verdicts(docs).collect()
    assert len(got) == n and all(r.kept and r.distance is not None for r in got)
