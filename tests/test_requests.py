import json

import pytest

from tallyward import model
from tallyward.operators import privacy, sampling
from tallyward.sources import requests


def test_messages_are_read_and_checked(spark, tmp_path):
    (tmp_path / "starts").mkdir()
    (tmp_path / "asked").mkdir()
    start = {"fl_id": 1, "client_ids": [3, 4], "sigma": 1.0, "clipping": 1.0, "alpha": 0.5, "sampling_ratio": 1.0, "aggregation_alg": 4, "num_of_parameters": 4, "num_of_sparse_parameters": 2, "other": 5}
    (tmp_path / "starts/a.json").write_text(json.dumps(start) + "\n" + json.dumps(start | {"fl_id": 2, "client_ids": [7]}))
    starts = requests.read(spark, str(tmp_path / "starts"), "start")
    assert starts.columns == [f.split()[0] for f in model.START.split(", ")]
    jobs = model.started(None, starts, "fl_id")
    ask = {"fl_id": 1, "round": 0, "encrypted_parameters": "A" * 43 + "=", "num_of_parameters": 4, "num_of_sparse_parameters": 2, "optimal_num_of_clients": 1, "aggregation_alg": 4, "client_ids": [4, 3]}
    rows = [ask, ask | {"fl_id": 9}, ask | {"round": 1}, ask | {"client_ids": [3]}, ask | {"optimal_num_of_clients": 3}, ask | {"encrypted_parameters": None}, {"fl_id": 2}]
    (tmp_path / "asked/a.json").write_text("\n".join(map(json.dumps, rows)))
    asked = requests.read(spark, str(tmp_path / "asked"), "aggregate")
    got = [r.status for r in requests.checked(asked.coalesce(1), jobs).collect()]
    assert sorted(got) == sorted(["ok", "unknown_job", "early_round", "roster_mismatch", "batch_too_large", "payload_mismatch", "algorithm_mismatch"])
    after = {r.fl_id: r["round"] for r in model.advanced(jobs, requests.checked(asked, jobs)).collect()}
    assert after == {1: 1, 2: 0}
    again = model.started(model.advanced(jobs, requests.checked(asked, jobs)), starts.where("fl_id = 2"), "fl_id")
    assert {r.fl_id: r["round"] for r in again.collect()} == {1: 1, 2: 0}
    assert requests.read(spark, str(tmp_path / "asked"), "aggregate", stream=True).isStreaming


def test_replies(spark):
    means = spark.createDataFrame([(2, 0.5), (0, 1.5), (1, -1.0)], "idx long, value double")
    r = requests.replies(means, spark.createDataFrame([(4, 9), (4, 3)], "round long, client_id long"), 0.25).first()
    assert (r.updated_parameters, r.execution_time, r.client_ids, r["round"]) == ([1.5, -1.0, 0.5], 0.25, [3, 9], 4)


@pytest.mark.parametrize("distribution", ["iid", "noniid", "unequal", "one_per_user"])
def test_datasets_by_distribution(spark, distribution):
    examples = spark.range(120).selectExpr("id AS example_id", "id % 4 AS label")
    owned, labels = sampling.federated(examples, distribution, 6, seed=1, labels_each=2, shard_size=5)
    rows = owned.collect()
    assert len({r.example_id for r in rows}) == len(rows) > 100
    assert {r.client_id: r.labels for r in labels.collect()} == {c: sorted({r.label for r in rows if r.client_id == c}) for c in {r.client_id for r in rows}}
    with pytest.raises(ValueError):
        sampling.federated(examples, "other", 6, seed=1)


def test_client_level_mean(spark):
    rows = [(1, 0, c, i, 3.0 * (i + 1)) for c in range(4) for i in range(3)]
    u = spark.createDataFrame(rows, "fl_id long, round int, client_id long, idx long, value double")
    still = {r.idx: r.value for r in privacy.client_level_mean(u, 4, 3, 0.0, 1.0, "s").collect()}
    assert sum(v * v for v in still.values()) == pytest.approx(1.0)
