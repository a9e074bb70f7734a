"""Language ID: averaged hashed subword embeddings with a linear softmax, fitted by stochastic gradient descent.

A text is the average of the embeddings of its hashed byte n-grams that lie within one word or touch its edge;
a linear layer and a softmax give the language. A temperature fitted on rows kept out of the fit calibrates the
probabilities, and a threshold fitted on the same rows says which predictions to accept.

The fit uses a bounded sample: ``sample_rows`` texts in all, shared evenly by the languages and chosen by a hash of
the row, and of each a window of at most ``window_bytes`` whole words from a place that the hash decides, so a text of
any length can be learned from and the driver holds at most sample_rows * window_bytes. Prediction runs over every whole text, and each is predicted by
itself: what stands beside it in a batch has no part in it.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and not accepted; so is every text where
no language can be learned. A null doc_id is one like any other; repeated rows and ids count as often as they are
there, up to the bound of the sample; of equally likely languages the first in code-point order is given; huge texts are read in
one piece; columns beside doc_id, text and lang are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base
from .textcore import SPACE, TABLE, Words, per_text

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
SIZE = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACE] = 32
_PART = (TABLE.reshape(32, 256)[:4] >> np.uint64(32)).astype(np.uint32)
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes | None) -> bool:
    return text is not None and _LETTER.search(text.decode("utf-8", "replace")) is not None


def ngrams(buf: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """The bucket of the k bytes from each place; BUCKETS where white space stands inside them or the text ends.

    at: where each text begins in buf and, last, where buf ends. A text's first byte must be white space of its own,
    as its last is, so that its words have both edges wherever it stands.
    """
    a = _LOWER[buf]
    n = len(a) - k + 1
    out = np.full(len(a), BUCKETS, np.int32)
    if n <= 0:
        return out
    h = np.full(n, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    bad = np.zeros(n, bool)
    blank = a == 32
    for j in range(k):
        h += _PART[j][a[j : n + j]]
        if 0 < j < k - 1:
            bad |= blank[j : n + j]
    if k == 2:
        bad = blank[:n] & blank[1:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    out[:n] = np.where(bad, BUCKETS, h >> np.uint32(17))
    for back in range(1, k):  # what begins so near the end of its text would reach into the next one
        out[np.maximum(at[1:] - back, at[:-1])] = BUCKETS
    return out


def edged(texts) -> Words:
    """The texts with a line feed before each; Words adds one after."""
    return Words([b"\n" + (t if isinstance(t, bytes) else (t or "").encode()) for t in texts])


class Model:
    """labels; table: a row of scores (or of embeddings, with ``weights``) for each bucket, the last one empty."""

    def __init__(self, labels, embedding, weights, bias, temperature=1.0, accept=0.0):
        self.labels, self.embedding, self.weights, self.bias = labels, embedding, weights, bias
        self.temperature, self.accept = temperature, accept

    def logits(self, texts) -> np.ndarray:
        w = edged([b"" if t is None else t for t in texts])
        if not len(w.raw):
            return np.zeros((0, len(self.labels)))
        direct = len(self.labels) <= SIZE
        table = np.vstack([self.embedding @ self.weights if direct else self.embedding, np.zeros((1, len(self.labels) if direct else SIZE))])
        table = np.ascontiguousarray(table.T.astype(np.float32)).astype(np.float64)  # no casting within sums: parts would depend on the batch
        total, count = np.zeros((len(w.raw), table.shape[0])), np.zeros(len(w.raw))
        for k in ORDERS:
            at = ngrams(w.buf, k, w.at)
            count += per_text((at < BUCKETS).view(np.uint8), w.at)
            for c in range(table.shape[0]):
                total[:, c] += np.add.reduceat(table[c][at], w.at[:-1])
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if direct else mean @ self.weights) + self.bias

    def probabilities(self, texts) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sparse(text: bytes):
    w = edged([text])
    at = np.concatenate([ngrams(w.buf, k, w.at) for k in ORDERS])
    index, count = np.unique(at[at < BUCKETS], return_counts=True)
    return index, (count / max(1, count.sum())).astype(np.float32)


def fit(texts: list[bytes], labels: list[str], epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model | None:
    """Stochastic gradient descent over whole texts and, so that short ones are known too, over pieces of a few words."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    aside = rng.random(len(y)) < 0.2 if len(y) >= 20 else np.zeros(len(y), bool)
    examples, target = [], []
    for t, c, out in zip(texts, y, aside):
        if out:
            continue
        words = t.split()
        pieces = [t]
        for size in (3, 12):
            at = int(rng.integers(0, max(1, len(words) - size)))
            pieces.append(b" ".join(words[at : at + size]))
        for p in pieces:
            index, share = _sparse(p)
            if len(index):
                examples.append((index, share))
                target.append(c)
    embedding = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    weights = rng.normal(0, 0.1, (SIZE, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    total, seen = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            index, share = examples[i]
            step = 1 - seen / total
            seen += 1
            x = share @ embedding[index]
            g = softmax(x @ weights + bias)
            g[target[i]] -= 1
            back = weights @ g
            weights -= 0.2 * step * np.outer(x, g)
            bias -= 0.05 * step * g
            embedding[index] -= (rate * step) * share[:, None] * back[None, :]
    model = Model(names, embedding, weights, bias)
    if aside.any():
        held = [t for t, out in zip(texts, aside) if out]
        held += [b" ".join(t.split()[:3]) for t in held]  # short texts count as much for the calibration
        z, truth = model.logits(held), np.tile(y[aside], 2)
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(2.0 ** np.linspace(-4, 4, 33), key=loss))
        p = softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99)
        model.accept = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def window(text: bytes, turn: int, most: int) -> bytes:
    """A run of whole words of at most so many bytes; turn, a hash, decides where it begins in a longer text."""
    if len(text) <= most:
        return text
    lo = turn % (len(text) - most + 1)
    part = text[lo : lo + most]
    words = part.split()
    cut_left, cut_right = lo > 0 and not SPACE[text[lo - 1]], lo + most < len(text) and not SPACE[text[lo + most]]
    inner = words[int(cut_left and not SPACE[part[0]]) : len(words) - int(cut_right and not SPACE[part[-1]])]
    return b" ".join(inner) if inner else part.decode("utf-8", "ignore").encode()


def sample(rows: DataFrame, sample_rows: int, window_bytes: int):
    """Up to about sample_rows (window of a text, lang), evenly by language, the first in the order of a hash of the row.

    Only hashes are ranked; the texts that they stand for are read again and cut in the executors.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 62)))
    short = rows.select("lang", "h")
    sizes = base.written(short.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")).withColumnRenamed("lang", "l"), "langs")
    langs = sizes.count()
    each = max(1, sample_rows // max(1, langs))
    # A hash decides who comes into question, about twice as many as are asked for, so that no task ranks a whole language;
    # the least hash always does, so that a language of a few rows with many copies isn't lost.
    share = F.col("h") / F.lit(float(1 << 62))
    near = short.join(base.small(sizes, langs, 10_000), F.col("lang") == F.col("l")).where((share * F.col("n") < 2 * each + 50) | (F.col("h") == F.col("first")))
    near = near.groupBy("lang", "h").agg(F.count("*").alias("times"))  # equal rows share a hash and are one candidate
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    chosen = base.written(first.select(F.col("lang").alias("l"), F.col("h").alias("g"), F.least("times", F.lit(each)).alias("times")), "chosen")
    hit = rows.join(base.small(chosen, chosen.count(), 100_000), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("g")))
    cut = F.udf(window, "binary", useArrow=False)
    one = hit.groupBy("lang", "h", "times").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    one = one.select("lang", "h", "times", cut(F.col("row.text").cast("binary"), F.col("h"), F.lit(window_bytes)).alias("text"))
    got = one.toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    texts, langs_, left = [], [], {}
    for t, x, n in zip(got.column("text").to_pylist(), got.column("lang").to_pylist(), got.column("times").to_pylist()):
        n = min(n, left.setdefault(x, each))  # a text that is there many times counts so often, within its language's share
        left[x] -= n
        texts += [t] * n
        langs_ += [x] * n
    return texts, langs_


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score and accepted of each document."""

    def make():
        def run(texts):
            n = len(texts)
            if model is None:
                return {"lang_pred": ["und"] * n, "score": np.zeros(n), "accepted": np.zeros(n, bool)}
            known = np.array([has_letter(t) for t in texts], bool)
            p = model.probabilities(texts)
            best, top = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
            return {
                "lang_pred": [model.labels[b] if k else "und" for b, k in zip(best, known)],
                "score": np.where(known, top, 0.0),
                "accepted": known & (top >= model.accept),
            }

        return run

    return base.map_texts(docs, make, "lang_pred string, score double, accepted boolean", keep)


def op10_language_id(spark: SparkSession, sf_dir: str, sample_rows: int = 4000, window_bytes: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of each document; see the top of the module for odd rows."""
    docs = base.read(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (base.crc_mod("doc_id", 5) == 0).alias("held_out"))
    model = fit(*sample(docs.where(~F.col("held_out")), sample_rows, window_bytes))
    return predict(docs, model, ("doc_id", "held_out"))
