"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays.

The statistics of every whole text are computed once and written; a bounded sample of labelled rows
(``sample_rows`` different ones, the first in the order of a hash of the row) fits the trees on the driver in numpy; every
row is scored by walking all trees a level at a time over arrays. The hash also decides who is ranked at all, about twice as many
as are asked for, so what reaches the last task doesn't grow with the table or its partitions.

Defined cases: a null or empty text has all-zero counts and is scored like any other; rows without a doc_id or a label, or with
a label other than 0 and 1, aren't learned from; without labelled rows every score is 0.5, with one class only its
smoothed share; repeated rows and labels are one row each that weighs as often as it is there; equally good splits go to the first
feature and the lowest limit; huge texts are measured whole; columns beside those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .textcore import STATS, doc_stats

FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "letters", "copied_lines", "repeats", "variety", "sentences", "words_in_line", "longest_word", "log_points")


def features(texts) -> np.ndarray:
    s = dict(zip(STATS, doc_stats(texts).T))
    n, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    cols = (np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / chars, s["n_upper"] / chars, s["n_digits"] / chars, s["n_letters"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / n, s["n_distinct"] / n, s["n_stops"] / n, s["n_words"] / lines, s["longest_word"], np.log1p(s["n_points"]))
    return np.stack(cols, axis=1)


class Trees:
    """Trees of one depth as complete binary trees in arrays: node k has its children at 2k+1 and 2k+2."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.feature, self.limit, self.value = [], [], []

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 128, ridge: float = 1.0, least: float = 2.0, weight: np.ndarray | None = None) -> Trees:
    """Logistic boosting; each split is the best of the gradient histograms of all features. weight: of each row."""
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    share = (float(weight @ y) + 1) / (float(weight.sum()) + 2)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    margin = np.full(n, model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            best = np.full(k, 1e-9)
            local = node - first
            for f in range(width):
                key = local * bins + code[:, f]
                hg = np.bincount(key, g, k * bins).reshape(k, bins)
                hh = np.bincount(key, h, k * bins).reshape(k, bins)
                lg, lh = np.cumsum(hg, 1)[:, :-1], np.cumsum(hh, 1)[:, :-1]
                tg, th = hg.sum(1, keepdims=True), hh.sum(1, keepdims=True)
                gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
                gain[(lh < least) | (th - lh < least)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                better = gain[np.arange(k), at] > best
                best[better] = gain[np.arange(k), at][better]
                feature[first : first + k][better] = f
                limit[first : first + k][better] = edges[f][at[better]] if len(edges[f]) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        model.feature.append(feature)
        model.limit.append(limit)
        model.value.append(value)
    return model


def featured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def make():
        return lambda texts: dict(zip(FEATURES, features(texts).T))

    return base.map_texts(docs, make, ", ".join(f"{f} double" for f in FEATURES), keep)


def learned(rows: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> Trees:
    """The trees fitted on up to sample_rows different ones of the rows that have a label."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    labels = labels.groupBy("doc_id", "y").agg(F.count("*").alias("times"))
    got = rows.select("doc_id", *FEATURES).join(labels, "doc_id").withColumn("h", F.pmod(F.xxhash64("doc_id", "y", *FEATURES), F.lit(1 << 62)))
    got = base.written(got, "labelled")
    count, first = got.agg(F.count("*"), F.min("h")).first()
    near = got.where((F.col("h") / F.lit(float(1 << 62)) * F.lit(count) < 2 * sample_rows + 100) | (F.col("h") == F.lit(first or 0)))
    near = near.groupBy("h", "doc_id", "y", *FEATURES).agg(F.sum("times").alias("weight"))  # equal rows share a hash
    got = near.orderBy("h", "doc_id", "y").limit(sample_rows).select("y", "weight", *FEATURES).toArrow()
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, got.column("y").to_numpy().astype(float), weight=got.column("weight").to_numpy().astype(float))


def scored(rows: DataFrame, model: Trees, keep: tuple[str, ...]) -> DataFrame:
    """keep and score of each row of features."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    source = rows.select(*keep, *FEATURES)
    schema = StructType([f for f in source.schema.fields if f.name in keep] + [StructField("score", DoubleType())])

    def run(batches):
        for b in batches:
            x = np.stack([b.column(f).to_numpy() for f in FEATURES], axis=1)
            columns = [b.column(k) for k in keep] + [pa.array(model.scores(x))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "score"])

    return source.mapInArrow(run, schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str, sample_rows: int = 40_000) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    docs = base.read(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (base.crc_mod("doc_id", 3) == 1).alias("held_out"))
    rows = base.written(featured(docs, ("doc_id", "held_out")), "features")
    model = learned(rows.where(~F.col("held_out")), base.read(spark, sf_dir, "labels"), "quality", sample_rows)
    out = scored(rows, model, ("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
