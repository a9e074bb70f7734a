"""Quality rules: robust multivariate outliers among documents.

Every document becomes a vector of transformed statistics, in whole units of 1 / UNIT. For each language and source a
regularised minimum covariance determinant estimate (location and scatter of the share of the rows whose scatter has the least
determinant) gives Mahalanobis distances; a document too far out is rejected.

A group of up to ``exact_rows`` rows is searched in one task: every part where those are few, else from hundreds of
small random parts (seeded, rows in the order of their values). In larger groups the minimum is sought from several deterministic starts: spreads along the axes, the correlations of squashed
coordinates, and those of directions only. Concentration steps from each never raise the determinant; after two the
start with the least is followed until no determinant falls any more, and the least model of each group is kept.

That search is distributed: a concentration step is one aggregation of moments by group, start and distance bin, with
partial sums in each task, and a small update for each group; rows of a hot source are never gathered. A step reads each row
once and measures it by all starts in place; rows are joined with models only where those are too many to send along. Of the
bin in which the h-th nearest row lies, the share that is needed counts. All sums are of whole numbers, so reruns agree to
the last bit.

Defined cases: a null text has no words and fails the base rules; null languages and sources are values of their
own; a group of under ``min_rows`` rows is measured by the model of all rows of its language, and where that has as
few, of all rows of the table, whose least spreads are widened by min_rows / rows where these are fewer still; so every document that
passes the base rules is measured. Repeated rows count as often as they are there; rows at equal distances share their bin; a
coordinate beyond 16 counts as 16; huge texts are measured whole; columns beside those named may have any names; an empty table gives none.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .textcore import STATS, doc_stats

#: The vector: name, and the least spread that is taken as such. Ratios enter as square roots, which evens out their variance.
DIMENSIONS = (("word_length", 0.04), ("symbols", 0.05), ("capitals", 0.04), ("digits", 0.08), ("copied_lines", 0.2), ("repeats", 0.2), ("variety", 0.02), ("sentences", 0.02))
P = len(DIMENSIONS)
FLOOR = np.array([x for _, x in DIMENSIONS])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Coordinates are whole numbers of 1 / UNIT, up to LIMIT: sums of their products over 10^10 rows fit 64 bits.
UNIT, LIMIT = 1024, 16
#: Distances are binned at parts of an octave to find the h nearest rows of a group without sorting them.
BINS_PER_OCTAVE = 16


def _vectors():
    def run(texts):
        s = dict(zip(STATS, doc_stats(texts).T))
        n, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
        x = (
            np.log(chars / n),
            np.sqrt(s["n_symbols"] / chars),
            np.sqrt(s["n_upper"] / chars),
            np.sqrt(s["n_digits"] / chars),
            np.sqrt(s["n_dup_lines"] / np.maximum(s["n_lines"], 1)),
            np.sqrt(s["n_repeat_words"] / n),
            np.log(np.maximum(s["n_distinct"], 1)) / np.log(n + 1),
            s["n_stops"] / n,
        )
        return {k: s[k].astype(np.int64) for k in COUNTS} | {f"x{i}": np.rint(np.clip(v, -LIMIT, LIMIT) * UNIT).astype(np.int64) for i, v in enumerate(x)}

    return run


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The exact counts and the vector x0.. of each document."""
    fields = ", ".join([f"{k} long" for k in COUNTS] + [f"x{i} long" for i in range(P)])
    return base.map_texts(docs, _vectors, fields, keep)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi2_cdf(x: float, k: int) -> float:
    """The regularised lower incomplete gamma function at k/2, x/2, by its series."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def _pairs():
    return [(i, j) for i in range(P) for j in range(i, P)]


#: log_det: of the scatter that a model was made from.
_MODEL = ", ".join(["grp string", "start long", "rows long", "log_det double"] + [f"m{i} double" for i in range(P)] + [f"p{i}_{j} double" for i, j in _pairs()])


def _model_row(group, start, rows, mean, cov, min_rows, factor=1.0):
    """factor: what makes the scatter of a part that of the whole; the determinant is of the scatter before it."""
    least = np.diag(FLOOR**2) * max(1.0, min_rows / max(rows, 1))
    inv = np.linalg.inv(factor * cov + least)
    out = {"grp": [group], "start": [start], "rows": [int(rows)], "log_det": [float(np.linalg.slogdet(cov + least)[1])]}
    out |= {f"m{i}": [float(mean[i])] for i in range(P)}
    return out | {f"p{i}_{j}": [float(inv[i, j] * (1 if i == j else 2))] for i, j in _pairs()}


def _table(rows):
    import pyarrow as pa

    return pa.table({k: [v for r in rows for v in r[k]] for k in rows[0]})


def _centre(table):
    """Of a group, from counts of its coordinates: medians, and spreads from the middle half, no less than the least."""
    t = table.to_pandas()
    out = {"g": [t["grp"].iloc[0]], "n": [int(t.loc[t["dim"] == 0, "n"].sum())]}
    for d, part in t.groupby("dim"):
        part = part.sort_values("value")
        share = part["n"].cumsum().to_numpy() / part["n"].sum()
        at = lambda q: float(part["value"].to_numpy()[np.searchsorted(share, q)]) / UNIT  # noqa: B023, E731
        out |= {f"c{d}": [at(0.5)], f"w{d}": [max((at(0.75) - at(0.25)) / 1.349, FLOOR[d])]}
    return _table([out])


def _starts(min_rows: int):
    """Three models of a group: its spreads alone, and with the correlations of squashed coordinates and of directions."""

    def run(table):
        t = table.to_pandas()
        r = t.iloc[0]
        mean, width = np.array([r[f"c{i}"] for i in range(P)]), np.array([r[f"w{i}"] for i in range(P)])
        rows = [_model_row(r["g"], 0, r["n"], mean, np.diag(width**2), min_rows)]
        for start, kind in ((1, "t"), (2, "d")):
            s = np.zeros((P, P))
            for i, j in _pairs():
                s[i, j] = s[j, i] = float(r[f"{kind}{i}_{j}"])
            scale = np.sqrt(np.maximum(np.diag(s), 1.0))
            near = 0.95 * s / np.outer(scale, scale)
            near[np.arange(P), np.arange(P)] = 1.0
            rows.append(_model_row(r["g"], start, r["n"], mean, np.outer(width, width) * near, min_rows))
        for row in rows:
            row["log_det"] = [float("inf")]  # not of any part of the rows
        return _table(rows)

    return run


def _concentrate(share: float | None, cut: float | None, min_rows: int):
    """One step: the moments of the h nearest rows (or of those within the cut) make the next model."""

    def run(table):
        t = table.to_pandas().sort_values("bin")
        n = t["n"].to_numpy().astype(float)
        total = n.sum()
        if cut is None:
            h = math.ceil(share * total)
            weight = np.clip(h - (np.cumsum(n) - n), 0, n) / n  # the last bin counts in part
        else:
            weight = (t["bin"].to_numpy() <= math.floor(BINS_PER_OCTAVE * math.log2(cut + 2**-10))).astype(float)
            if not weight.any():
                weight[0] = 1.0
        m = float((weight * n).sum())
        part = lambda c: float((weight * t[c].to_numpy().astype(float)).sum()) / m
        mean = np.array([part(f"s{i}") for i in range(P)]) / UNIT
        cov = np.zeros((P, P))
        for i, j in _pairs():
            cov[i, j] = cov[j, i] = part(f"s{i}_{j}") / UNIT**2 - mean[i] * mean[j]
        kept = min(m / total, 0.999)
        factor = kept / max(chi2_cdf(chi2_quantile(kept, P), P + 2), 1e-9)  # consistent under a normal law
        return _table([_model_row(t["grp"].iloc[0], int(t["start"].iloc[0]), total, mean, cov, min_rows, factor)])

    return run


def least_part(x: np.ndarray, h: int, least: np.ndarray, starts: int = 300, every: int = 5000, seed: int = 11) -> tuple[np.ndarray, float]:
    """The h rows whose regularised scatter has the least determinant, and its logarithm."""
    n = len(x)

    def log_det(at):
        return np.linalg.slogdet(np.cov(x[at].T, bias=True).reshape(P, P) + least)[1]

    if math.comb(n, h) <= every:
        best = min((list(c) for c in combinations(range(n), h)), key=log_det)
        return np.array(best), log_det(best)

    def nearest(at):
        d = x - x[at].mean(0)
        return np.sort(np.argsort(((d @ np.linalg.inv(np.cov(x[at].T, bias=True) + least)) * d).sum(1), kind="stable")[:h])

    rng = np.random.default_rng(seed)
    width = np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, FLOOR)
    z = (x - np.median(x, axis=0)) / width
    parts = [np.argsort((z * z).sum(1), kind="stable")[:h]] + [nearest(nearest(rng.choice(n, P + 1, replace=False))) for _ in range(starts)]
    found = []
    for at in sorted(parts, key=log_det)[:10]:
        was = log_det(at)
        while (now := log_det(then := nearest(at))) < was - 1e-12:
            at, was = then, now
        found.append((was, at))
    was, at = min(found, key=lambda f: f[0])
    return at, was


def _searched(share: float, cut: float, min_rows: int):
    """The reweighted model of a small group from its rows."""

    def run(table):
        x = np.stack([table.column(f"x{i}").to_numpy() for i in range(P)], axis=1)
        x = x[np.lexsort(x.T)] / UNIT
        n = len(x)
        h = math.ceil(share * n)
        wide = np.diag(FLOOR**2) * max(1.0, min_rows / n)
        at, _ = least_part(x, h, wide)
        part = min(h / n, 0.999)
        cov = np.cov(x[at].T, bias=True) * part / max(chi2_cdf(chi2_quantile(part, P), P + 2), 1e-9)
        d = x - x[at].mean(0)
        inside = ((d @ np.linalg.inv(cov + wide)) * d).sum(1) <= cut
        inside[at] |= not inside.any()
        part = min(inside.mean(), 0.999)
        factor = part / max(chi2_cdf(chi2_quantile(part, P), P + 2), 1e-9)
        return _table([_model_row(table.column("grp")[0].as_py(), 0, n, x[inside].mean(0), np.cov(x[inside].T, bias=True), min_rows, factor)])

    return run


def _distance() -> Column:
    x = [F.col(f"x{i}") / F.lit(float(UNIT)) - F.col(f"m{i}") for i in range(P)]
    out = F.lit(0.0)
    for i, j in _pairs():
        out = out + F.col(f"p{i}_{j}") * x[i] * x[j]
    return F.greatest(out, F.lit(0.0))


def _bin() -> Column:
    return F.floor(BINS_PER_OCTAVE * F.log2(F.col("d2") + 2.0**-10)).cast("int")


#: Where bins start, from that of distance 0 on.
_FIRST = -10 * BINS_PER_OCTAVE
_EDGES = 2.0 ** (np.arange(_FIRST, 64 * BINS_PER_OCTAVE) / BINS_PER_OCTAVE)
_SUMS = ["n"] + [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in _pairs()]


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(sums, first) if len(first) else sums


def _partial_moments(models: list, most: int = 20_000):
    """Of each task's rows, their number and the sums of their coordinates and products by group, start and distance bin.

    Every row is measured by each model of its group where it stands; a task holds ``most`` sums and a batch's at most.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names, starts = sorted({m["grp"] for m in models}), sorted({m["start"] for m in models})
    mean, inner = np.full((len(starts), len(names), P), np.nan), np.zeros((len(starts), len(names), len(_pairs())))
    for m in models:
        at = starts.index(m["start"]), names.index(m["grp"])
        mean[at], inner[at] = [m[f"m{i}"] for i in range(P)], [m[f"p{i}_{j}"] for i, j in _pairs()]

    def out(keys, sums):
        rest, of_bin = np.divmod(keys, len(_EDGES))
        group, start = np.divmod(rest, len(starts))
        columns = [pa.array(names, pa.string()).take(pa.array(group)), pa.array(np.array(starts, np.int64)[start]), pa.array((of_bin + _FIRST).astype(np.int32)), *map(pa.array, sums.T.copy())]
        return pa.RecordBatch.from_arrays(columns, ["grp", "start", "bin", *_SUMS])

    def run(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros((0, len(_SUMS)), np.int64)
        for b in batches:
            group = pc.index_in(b.column("grp"), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
            x = np.stack([b.column(f"x{i}").to_numpy() for i in range(P)], axis=1)
            moments = np.concatenate([np.ones((len(x), 1), np.int64), x, np.stack([x[:, i] * x[:, j] for i, j in _pairs()], axis=1)], axis=1)
            for k in range(len(starts)):
                z, d2 = x / float(UNIT) - mean[k, group], np.zeros(len(x))
                for c, (i, j) in enumerate(_pairs()):
                    d2 = d2 + inner[k, group, c] * z[:, i] * z[:, j]
                some = ~np.isnan(d2)  # no model of this start
                of_bin = np.searchsorted(_EDGES, np.maximum(d2[some], 0.0) + 2.0**-10, side="right") - 1
                now = _summed((group[some].astype(np.int64) * len(starts) + k) * len(_EDGES) + of_bin, moments[some])
                keys, sums = _summed(np.concatenate([keys, now[0]]), np.concatenate([sums, now[1]]))
            if len(keys) > most:
                yield out(keys, sums)
                keys, sums = keys[:0], sums[:0]
        if len(keys):
            yield out(keys, sums)

    return run


def cells_of(stats: DataFrame, min_rows: int) -> DataFrame:
    """(l, s, grp, fits): the group whose model measures each language and source, itself, its language or all, and the
    groups whose models its rows make: its own and those of its language and of all that a smaller one needs."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    cells = base.written(stats.where(~base_failed()).groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    by_lang = cells.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"), (F.min("n") < min_rows).alias("some_small"))
    pooled = by_lang.agg((F.coalesce(F.min("n_lang"), F.lit(0)) < min_rows).alias("some_lang_small"))
    own, whole = F.concat(name("lang"), F.lit("\x1f"), name("source")), F.concat(name("lang"), F.lit("\x1f*"))
    large, large_lang = F.col("n") >= min_rows, F.col("n_lang") >= min_rows
    cells = cells.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l").join(F.broadcast(pooled))  # one row
    cells = cells.withColumn("grp", F.when(large, own).when(large_lang, whole).otherwise(F.lit("*")))
    fits = F.array_compact(F.array(F.when(large, own), F.when(large_lang & F.col("some_small"), whole), F.when(F.col("some_lang_small"), F.lit("*"))))
    return base.written(cells.select(F.col("lang").alias("l"), F.col("source").alias("s"), "grp", fits.alias("fits")), "cells")


def grouped(stats: DataFrame, cells: DataFrame) -> DataFrame:
    cells = base.small(cells, cells.count(), 20_000)
    return stats.join(cells, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")


def _start_models(used: DataFrame, min_rows: int) -> DataFrame:
    """The models that concentration starts from."""
    long = used.select("grp", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("dim", "value"))
    counts = long.groupBy("grp", "dim", "value").agg(F.count("*").alias("n"))
    fields = "g string, n long, " + ", ".join(f"c{i} double, w{i} double" for i in range(P))
    centre = base.written(counts.groupBy("grp").applyInArrow(_centre, fields), "centre")
    z = used.join(base.small(centre, centre.count(), 5_000), F.col("grp") == F.col("g"))
    z = z.select("g", "n", *[f"c{i}" for i in range(P)], *[f"w{i}" for i in range(P)], *[((F.col(f"x{i}") / F.lit(float(UNIT)) - F.col(f"c{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i in range(P)])
    length = z["z0"] * z["z0"]
    for i in range(1, P):
        length = length + z[f"z{i}"] * z[f"z{i}"]
    z = z.withColumn("length", F.greatest(F.sqrt(length), F.lit(1e-9)))
    whole = lambda x: F.sum(F.floor(x * F.lit(float(UNIT**2))))
    sums = [whole(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in _pairs()]
    sums += [whole(F.col(f"z{i}") / F.col("length") * F.col(f"z{j}") / F.col("length")).alias(f"d{i}_{j}") for i, j in _pairs()]
    moments = z.groupBy("g").agg(*[F.first(c).alias(c) for c in ("n", *[f"c{i}" for i in range(P)], *[f"w{i}" for i in range(P)])], *sums)
    return base.written(moments.groupBy("g").applyInArrow(_starts(min_rows), _MODEL), "starts")


def estimate(rows: DataFrame, share: float, most: int, min_rows: int, exact_rows: int = 2000) -> DataFrame:
    """The model of each group; most: concentration steps at most, should a determinant still fall."""
    used = rows.where(~base_failed()).select("grp", *[f"x{i}" for i in range(P)])
    sizes = base.written(used.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("size")), "group_sizes")
    count, large = sizes.agg(F.count("*"), F.count_if(F.col("size") > exact_rows)).first()
    used = used.join(base.small(sizes, count, 5_000), F.col("grp") == F.col("g")).drop("g")
    cut = chi2_quantile(0.975, P)
    found = used.where(F.col("size") <= exact_rows).drop("size").groupBy("grp").applyInArrow(_searched(share, cut, min_rows), _MODEL)
    if not large:
        return base.written(found, "model")
    return base.written(found.unionByName(_concentrated(used.where(F.col("size") > exact_rows).drop("size"), share, most, min_rows, cut)), "model")


def _moments(used: DataFrame, model: DataFrame, groups: int, limit: int = 5_000) -> DataFrame:
    """The number of rows and the sums of coordinates and products by group, start and distance bin."""
    if groups <= limit:
        models = model.drop("rows", "log_det").collect()  # three for each group at most
        fields = "grp string, start long, bin int, " + ", ".join(f"{k} long" for k in _SUMS)
        parts = used.select("grp", *[f"x{i}" for i in range(P)]).mapInArrow(_partial_moments([m.asDict() for m in models]), fields)
        return parts.groupBy("grp", "start", "bin").agg(*[F.sum(k).alias(k) for k in _SUMS])
    sums = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _pairs()]
    near = used.join(model.drop("rows", "log_det"), "grp").withColumn("d2", _distance())
    return near.groupBy("grp", "start", _bin().alias("bin")).agg(*sums)


def _concentrated(used: DataFrame, share: float, most: int, min_rows: int, cut: float) -> DataFrame:
    """The models of large groups by distributed concentration steps."""
    model = _start_models(used, min_rows)
    groups = model.select("grp").distinct().count()

    def step(model: DataFrame, *how) -> DataFrame:
        moments = _moments(used, model, groups)
        return base.written(moments.groupBy("grp", "start").applyInArrow(_concentrate(*how, min_rows), _MODEL), "model")

    least = lambda df: df.groupBy("grp").agg(F.min_by(F.struct(*[c for c in df.columns if c != "grp"]), F.struct("log_det", "start")).alias("m")).select("grp", "m.*")
    for _ in range(2):
        model = step(model, share, None)
    model = base.written(least(model), "least")
    for _ in range(most - 2):
        after = step(model, share, None)
        before = model.select(F.col("grp").alias("g"), F.col("log_det").alias("was"))
        falls = after.join(before, F.col("grp") == F.col("g")).where(F.col("log_det") < F.col("was") - 1e-6).limit(1).count()
        model = base.written(least(model.unionByName(after)), "least")
        if not falls:
            break
    return step(model, None, cut)  # the usual reweighting: all rows within the 97.5 % ellipsoid


def fitted(stats: DataFrame, share: float = 0.65, most: int = 20, min_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """The groups of all languages and sources, and the model of each group, from written statistics.

    share: of a group's rows that a concentration step looks at.
    """
    cells = cells_of(stats, min_rows)
    rows = grouped(stats, cells.drop("grp")).withColumn("grp", F.explode("fits")).drop("fits")
    return cells.drop("fits"), estimate(rows, share, most, min_rows)


def judged(stats: DataFrame, cells: DataFrame, model: DataFrame, tail: float = 1e-5) -> DataFrame:
    """Adds base_failed, distance (null for what fails the base rules) and kept.

    tail: the chance that a document of a normal law would lie beyond the cut.
    """
    model = base.small(model.drop("rows", "start", "log_det"), model.count(), 5_000)
    out = grouped(stats, cells).join(model, "grp", "left").withColumn("d2", _distance()).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= chi2_quantile(1 - tail, P))))
    return out.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))


def verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the counts of each document, base_failed, distance and kept."""
    stats = base.written(statistics(docs, tuple(dict.fromkeys((*keep, "lang", "source")))), "stats")
    return judged(stats, *fitted(stats)).select(*keep, *COUNTS, "base_failed", "distance", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. The texts are read twice rather than moved."""
    stats = base.written(statistics(docs, ("lang", "source")), "stats")
    cells, model = fitted(stats)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", "text")
    return judged(statistics(rows, ("row", "lang", "source")), cells, model).where("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and distance of each document."""
    out = verdicts(base.read(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
