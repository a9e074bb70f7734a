"""Local training and inference of small networks in numpy, one client (or label, or round) to a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Mlp:
    """Hidden layers with relu, then log-softmax; parameters as one flat vector. hidden: the size of one layer, or of each."""

    def __init__(self, inputs: int, hidden: int | tuple[int, ...], classes: int, flat: np.ndarray | None = None, seed: int = 0):
        sizes = [inputs, *((hidden,) if isinstance(hidden, int) else hidden), classes]
        self.shapes = [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]
        self.size = sum(int(np.prod(s)) for s in self.shapes)
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, (2 / s[0]) ** 0.5, s).ravel() if len(s) == 2 else np.zeros(s) for s in self.shapes])
        self.flat = np.asarray(flat, float).copy()

    def parts(self, flat: np.ndarray | None = None):
        out, at = [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append((self.flat if flat is None else flat)[at : at + n].reshape(s))
            at += n
        return out

    def _layers(self, x: np.ndarray) -> list[np.ndarray]:
        """What goes into each layer, and what comes out of the last."""
        parts, out = self.parts(), [x]
        for i in range(0, len(parts), 2):
            z = out[-1] @ parts[i] + parts[i + 1]
            out.append(np.maximum(z, 0) if i + 2 < len(parts) else z)
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._layers(x)[-1]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        parts, layers = self.parts(), self._layers(x)
        z = layers[-1] - layers[-1].max(axis=1, keepdims=True)
        g = np.exp(z)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        g /= max(1, len(y))
        out = []
        for i in range(len(parts) - 2, -1, -2):
            into = layers[i // 2]
            out = [(into.T @ g).ravel(), g.sum(0), *out]
            g = (g @ parts[i].T) * (into > 0)
        return np.concatenate(out)

    def trained(self, x, y, epochs: int, rate: float, batch: int, momentum: float = 0.5, seed: int = 0) -> Mlp:
        rng, speed = np.random.default_rng(seed), np.zeros(self.size)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
                speed = momentum * speed + self.gradient(x[at], y[at])
                self.flat -= rate * speed
        return self


def _xy(p: pd.DataFrame):
    return np.stack(p["features"].to_numpy()).astype(float), p["label"].to_numpy().astype(int)


def local_updates(owned: DataFrame, base: list[float] | None, inputs: int, hidden: int, classes: int, epochs: int = 2, rate: float = 0.1, batch: int = 16, seed: int = 0, key: str = "client_id") -> DataFrame:
    """(key, idx, value): what training on its own examples changes in each client's copy of the model."""
    start = Mlp(inputs, hidden, classes, None if base is None else np.array(base), seed).flat

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("example_id")
        model = Mlp(inputs, hidden, classes, start).trained(*_xy(p), epochs, rate, batch, seed=seed)
        return pd.DataFrame({key: p[key].iloc[0], "idx": np.arange(model.size), "value": model.flat - start})

    return owned.select(key, "example_id", "features", "label").groupBy(key).applyInPandas(run, f"{key} long, idx long, value double")


def full_gradients(owned: DataFrame, base: list[float] | None, inputs: int, hidden: int, classes: int, seed: int = 0) -> DataFrame:
    """(client_id, idx, value): one gradient over all of a client's examples."""
    start = Mlp(inputs, hidden, classes, None if base is None else np.array(base), seed).flat

    def run(p: pd.DataFrame) -> pd.DataFrame:
        g = Mlp(inputs, hidden, classes, start).gradient(*_xy(p.sort_values("example_id")))
        return pd.DataFrame({"client_id": p["client_id"].iloc[0], "idx": np.arange(len(g)), "value": g})

    return owned.select("client_id", "example_id", "features", "label").groupBy("client_id").applyInPandas(run, "client_id long, idx long, value double")


def predictions(examples: DataFrame, flat: list[float], inputs: int, hidden: int, classes: int) -> DataFrame:
    """(example_id, label, predicted, loss)."""
    weights = np.array(flat)

    def run(parts):
        model = Mlp(inputs, hidden, classes, weights)
        for p in parts:
            if len(p):
                x, y = _xy(p)
                lp = model.log_probabilities(x)
                yield pd.DataFrame({"example_id": p["example_id"], "label": y, "predicted": lp.argmax(1), "loss": -lp[np.arange(len(y)), y]})

    return examples.select("example_id", "features", "label").mapInPandas(run, "example_id long, label long, predicted long, loss double")


def quality(predicted: DataFrame) -> DataFrame:
    """(accuracy, loss): share of hits, and the sum of losses."""
    return predicted.agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.sum("loss").alias("loss"))


def attack_scores(target: DataFrame, teacher: DataFrame, d: int, classes: int, hidden: int = 32, epochs: int = 50, rate: float = 0.2, seed: int = 0, rounds: int | None = None, mode: str = "rounds") -> DataFrame:
    """(client_id[, upto], label, score): log-probabilities of networks trained on the teacher's index sets.

    mode: "rounds" trains one network for each round and adds up what they say of a client; "single" trains one on all rounds
    side by side (index + round * d), where a round that a client missed is zeros; "prefixes" does that for the rounds
    up to each. The teacher may have batches (batch_no), each an example; side by side stand only those that every round has.
    Sets that train together meet in one task, which holds as many multi-hot rows, d wide for each round that counts.
    """
    from . import shaping

    if mode not in ("rounds", "single", "prefixes"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "rounds" and rounds is None:
        raise ValueError("the number of rounds is needed")
    if "batch_no" not in teacher.columns:
        teacher = teacher.withColumn("batch_no", F.lit(0))
    if mode == "rounds":
        group, width = "round", (lambda key: d)
    else:
        known = F.col("round") < rounds
        teacher, target = shaping.one_batch_apart(teacher.where(known)), target.where(known)
        upto = F.lit(rounds - 1) if mode == "single" else F.explode(F.sequence(F.col("round").cast("int"), F.lit(rounds - 1)))
        beside = lambda df: df.withColumn("upto", upto).withColumn("idx", F.col("idx") + F.col("round").cast("long") * d)
        teacher, target, group, width = beside(teacher), beside(target), "upto", (lambda key: d * (key + 1))
    sets = teacher.groupBy(group, "label", "batch_no").agg(F.array_sort(F.collect_set("idx")).alias("s")).select(F.col(group).cast("long").alias("g"), F.col("label").alias("id"), "batch_no", "s")
    asked = target.groupBy(group, "client_id").agg(F.array_sort(F.collect_set("idx")).alias("s")).select(F.col(group).cast("long").alias("g"), F.col("client_id").alias("id"), "s")

    def hot(rows, n: int) -> np.ndarray:
        x = np.zeros((len(rows), n))
        for i, s in enumerate(rows):
            x[i, np.asarray(s, int)] = 1
        return x

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"g": [], "client_id": [], "label": [], "score": []})
        left, right, n = left.sort_values(["id", "batch_no"]), right.sort_values("id"), width(int(key[0]))
        model = Mlp(n, hidden, classes, seed=seed).trained(hot(left["s"], n), left["id"].to_numpy().astype(int), epochs, rate, 32, seed=seed)
        lp = model.log_probabilities(hot(right["s"], n))
        return pd.DataFrame({"g": int(key[0]), "client_id": np.repeat(right["id"].to_numpy(), classes), "label": np.tile(np.arange(classes), len(right)), "score": lp.ravel()})

    out = sets.groupBy("g").cogroup(asked.groupBy("g")).applyInPandas(run, "g long, client_id long, label long, score double")
    if mode == "prefixes":
        return out.withColumnRenamed("g", "upto")
    return out.groupBy("client_id", "label").agg(F.sum("score").alias("score"))
