"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors, the exact graph of nearest neighbours is cut into balanced partitions (a refinement
that moves points to where most of their neighbours are, within a fixed capacity). A small softmax network learns
from that to tell the partition of any vector. Every vector of the table is then filed under its most probable
partition, and a query is routed to its several most probable ones, whose members are all compared exactly in double
precision. The number of partitions grows with the root of the rows; how many a query probes is measured on the
sample: as few as hold the wanted share of its true neighbours (the sample is thinner than the table, so those are further off).

Blocks of queries meet blocks of a partition's members in the executors; each block pair hands on the best few of
each query, and the best of those are kept. Both are cut by what a partition really holds, so a member is copied once
for each block of the queries that come to its partition, and a query for each block of members.

Defined cases: rows without a vec_id, null or zero vectors, and ones with null or non-finite components or of another length than most of
the sample, take no part; vectors are scaled by their largest component before anything is squared, so huge and tiny ones count like others; a query never finds its own row (rows that share its vec_id, if any, count as itself, and a
query that is there several times is answered once); of equal scores the smaller vec_id comes first; with
fewer candidates than asked for, all are returned; columns beside vec_id and embedding are ignored whatever their names; without a usable vector there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base


class Router:
    """One hidden layer: relu(x W1 + b1) W2 + b2 over normalised vectors."""

    def __init__(self, w1, b1, w2, b2):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbours(x: np.ndarray, k: int, block: int = 1000, of: np.ndarray | None = None) -> np.ndarray:
    """The exact k nearest of each row (or of those rows) among the others, in blocks."""
    of = np.arange(len(x)) if of is None else of
    out = np.zeros((len(of), k), np.int64)
    for lo in range(0, len(of), block):
        at = of[lo : lo + block]
        s = x[at] @ x.T
        s[np.arange(len(at)), at] = -np.inf
        out[lo : lo + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.15, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """The partition of each node: the share of edges within partitions grows while none exceeds its capacity."""
    rng = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(len(x) / parts * slack))
    centre = x[rng.choice(n, parts, replace=False)]
    where = np.full(n, -1)
    for step in range(rounds):
        if step < 4:  # start from balanced groups around centres
            score = x @ centre.T
        else:  # then follow the edges: votes of a node's neighbours, centres break ties
            votes = np.zeros((n, parts))
            np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), where[near].ravel()), 1.0)
            np.add.at(votes, (near.ravel(), np.repeat(where, near.shape[1])), 1.0)
            score = votes + 0.1 * (x @ centre.T)
        where = _assigned(score, room)
        for p in range(parts):
            if (where == p).any():
                c = x[where == p].mean(0)
                centre[p] = c / max(np.linalg.norm(c), 1e-12)
    return where


def _assigned(score: np.ndarray, room: int) -> np.ndarray:
    """Each row to its best column that has room; the rows that would lose most by a second choice go first."""
    order = np.argsort(-score, axis=1)
    top = np.take_along_axis(score, order[:, :2], 1)
    where, left = np.full(len(score), -1), np.full(score.shape[1], room)
    for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable"):
        for p in order[i]:
            if left[p]:
                where[i] = p
                left[p] -= 1
                break
    return where


def trained(x: np.ndarray, target: np.ndarray, parts: int, hidden: int = 128, epochs: int = 25, seed: int = 5) -> Router:
    """Adam on the cross entropy with the partitions (rows of target: shares) of a node and its neighbours."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    t = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[at]) / len(at)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((x[at].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                w[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def fit(x: np.ndarray, parts: int, graph_k: int = 10) -> Router:
    """The router learned from a sample of normalised vectors."""
    parts = max(1, min(parts, len(x) // 20))
    if parts == 1 or len(x) <= graph_k:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbours(x, graph_k)
    where = balanced_cut(x, near, parts)
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.repeat(np.arange(len(x)), graph_k), where[near].ravel()), 0.5 / graph_k)
    share[np.arange(len(x)), where] += 0.5
    return trained(x, share, parts)


def usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return v.where(F.size("v") == width) if width is not None else v


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1, which changes no cosine by a bit; only rows
    whose squares could leave the range of doubles are touched."""
    power = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    return np.where((np.abs(power) > 400)[:, None], np.ldexp(x, -power[:, None]), x)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1)


def sampled(rows: DataFrame, count: int, sample_rows: int) -> np.ndarray:
    """Up to sample_rows normalised vectors of the commonest length, the first by a hash of the id; only about twice as
    many are ranked."""
    near = rows.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 62))).where(F.col("h") / F.lit(float(1 << 62)) * F.lit(count) < 2 * sample_rows + 100)
    got = near.dropDuplicates(["vec_id"]).orderBy("h", "vec_id").limit(sample_rows).select("v").toArrow().column("v").to_pylist()
    sizes = [len(v) for v in got]
    if not sizes:
        return np.zeros((0, 0))
    width = max(sorted(set(sizes)), key=sizes.count)
    return unit(np.array([v for v in got if len(v) == width]))


def probes_for(x: np.ndarray, router: Router, k: int, recall: float, of: np.ndarray) -> int:
    """How many partitions those rows of the sample must probe to meet that share of their k nearest in it."""
    parts = router.w2.shape[1]
    if len(x) <= k or parts == 1 or not len(of):
        return parts
    home = router.logits(x).argmax(1)
    order = np.argsort(np.argsort(-router.logits(x[of]), axis=1, kind="stable"), axis=1)  # the place of each partition
    ranks = np.sort(order[np.arange(len(of))[:, None], home[neighbours(x, k, of=of)]].ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def indexed(rows: DataFrame, router: Router) -> DataFrame:
    """(part, vec_id, v): every row in its most probable partition."""

    def run(it):
        for b in it:
            x = _matrix(b.column("v"))
            part = router.logits(unit(x)).argmax(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column("vec_id"), b.column("v")], ["part", "vec_id", "v"])

    return base.written(rows.mapInArrow(run, "part int, vec_id long, v array<double>"), "index")


def routed(queries: DataFrame, router: Router, probes: int) -> DataFrame:
    """(part, query_id, q): each query at its most probable partitions."""

    def run(it):
        for b in it:
            x = _matrix(b.column("v"))
            if not len(x):
                continue
            z = router.logits(unit(x))
            best = np.argsort(-z, axis=1)[:, :probes]
            at = np.repeat(np.arange(len(x)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), b.column("vec_id").take(pa.array(at)), b.column("v").take(pa.array(at))], ["part", "query_id", "q"])

    return queries.mapInArrow(run, "part int, query_id long, q array<double>")


def _best(k: int):
    """The k nearest members of a block for each query of a block, ties to the smaller vec_id."""

    def run(key, left, right):
        ids, x = left.column("vec_id").to_numpy(), scaled(_matrix(left.column("v")))
        asked, y = right.column("query_id").to_numpy(), scaled(_matrix(right.column("q")))
        out: list = [[], [], []]
        if len(ids) and len(asked):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            norm = np.sqrt((x * x).sum(1))
            for lo in range(0, len(asked), 256):
                q = y[lo : lo + 256]
                size = np.sqrt((q * q).sum(1))
                s = (q @ x.T) / (size[:, None] * norm)
                s[asked[lo : lo + 256, None] == ids] = -np.inf
                top = min(k, len(ids))
                limit = -np.partition(-s, top - 1, axis=1)[:, top - 1]
                for i, row in enumerate(s):
                    at = np.flatnonzero((row >= limit[i] - 1e-9) & (row > -np.inf))
                    exact = (x[at] * q[i]).sum(1) / (size[i] * norm[at])  # alike for equal vectors, wherever they stand
                    best = np.argsort(-exact, kind="stable")[:top]
                    out[0] += [asked[lo + i]] * len(best)
                    out[1] += ids[at[best]].tolist()
                    out[2] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def _blocks(parts: DataFrame, each: int, name: str) -> DataFrame:
    """How many blocks of about ``each`` rows a partition has: one row for each partition."""
    return parts.groupBy(F.col("part").alias("p")).agg(F.ceil(F.count("*") / each).cast("int").alias(name))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int | None = None, probes: int | None = None, recall: float = 0.95, sample_rows: int = 6000, members: int = 20_000, asking: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query.

    parts: by default the root of a quarter of the rows, from 16 up, as far as the sample has 20 rows for each; the sample is of sample_rows, or of 40 for
    each part if that is more, up to five times as many. probes: by default as many as the sample says for the recall. A block has at most about
    ``members`` members or ``asking`` queries.
    """
    rows = usable(vectors)
    count = rows.count()
    wanted = max(16, int((count / 4) ** 0.5)) if parts is None else parts
    sample_rows = max(sample_rows, min(40 * wanted, 5 * sample_rows))
    sample = sampled(rows, count, sample_rows)
    width = sample.shape[1]
    aside = len(sample) // 5 if probes is None and len(sample) >= 200 else 0  # not fitted on, so that recall is that of new queries
    router = fit(sample[aside:], wanted) if len(sample) else Router(np.zeros((0, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    probes = probes_for(sample, router, k, recall, np.arange(aside)) if probes is None else probes
    members = min(members, max(500, count // (4 * wanted)))
    index = indexed(usable(vectors, width), router)
    asked = base.written(routed(usable(queries, width).groupBy("vec_id").agg(F.min("v").alias("v")), router, probes), "routed")
    # A row for each partition, which the sample bounds.
    cut = base.written(_blocks(index, members, "blocks").join(_blocks(asked, asking, "query_blocks").withColumnRenamed("p", "p2"), F.col("p") == F.col("p2")).drop("p2"), "blocks")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(F.broadcast(cut), F.col("part") == F.col("p"))
    asked = asked.select("part", every("blocks").alias("block"), place("query_id", "query_blocks").alias("query_block"), "query_id", "q")
    index = index.join(F.broadcast(cut), F.col("part") == F.col("p"))
    index = index.select("part", place("vec_id", "blocks").alias("block"), every("query_blocks").alias("query_block"), "vec_id", "v")
    keys = ("part", "block", "query_block")
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 5 nearest found of every query."""
    vectors = base.read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
