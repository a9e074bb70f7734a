"""Noise, local perturbation and protections of index sets, seeded so that reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import laplace, micro, normal, order_key, uniform


def gaussian(vector: DataFrame, sigma: float, clipping: float, n: int, seed) -> DataFrame:
    """Adds N(0, clipping * sigma) / n to each coordinate of an averaged vector."""
    return vector.withColumn("value", F.col("value") + F.lit(clipping * sigma / n) * normal(seed, "idx"))


def client_level_mean(updates: DataFrame, n: int, d: int, sigma: float, clipping: float, seed, exact: bool = False) -> DataFrame:
    """(sum of clipped updates + noise) / n."""
    from .aggregate import mean
    from .shaping import clipped

    return gaussian(mean(clipped(updates, clipping), n, d, exact=exact), sigma, clipping, n, seed)


def laplace_threshold(d: int, k: int, epsilon: float, delta: float) -> tuple[float, float]:
    """The scale 2k / epsilon, and the size that noise exceeds with a chance of delta over d draws."""
    scale = 2 * k / epsilon
    return scale, scale * math.log(d / delta)


def dummy_counts(indices: DataFrame, d: int, k: int, epsilon: float, delta: float, seed) -> DataFrame:
    """(idx, noise, dummies): Laplace noise to a whole number of 0 and above."""
    scale, limit = laplace_threshold(d, k, epsilon, delta)
    x = laplace(seed, scale, "idx")
    whole = F.when(F.abs("noise") > limit, F.ceil(F.lit(limit))).otherwise((F.lit(limit) + F.ceil("noise")).cast("long"))
    return indices.select("idx", x.alias("noise")).withColumn("dummies", F.greatest(whole, F.lit(0)).cast("long"))


def dummies(counts: DataFrame, limit: float) -> DataFrame:
    """(idx, value): zero cells, max(floor(limit) - 1 - dummies, 0) for each index."""
    n = F.greatest(F.lit(math.floor(limit) - 1) - F.col("dummies"), F.lit(0))
    return counts.withColumn("n", n).where("n > 0").select("idx", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("idx", F.lit(0.0).alias("value"))


def permutation_steps(d: int, n: int = 16) -> list[int]:
    """Up to n numbers coprime to d, spread over its range: multiplication by one permutes 0..d-1."""
    out = []
    for i in range(n):
        s = max(1, round(d * (i + 0.618) / n))
        while math.gcd(s, d) != 1:
            s += 1
        if s % d not in out:
            out.append(s % d if d > 1 else 1)
    return out


def index_privacy(sets: DataFrame, d: int, r: float, seed, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """(keys, idx, real): int(n * r) indices that a client didn't choose (or all there are) join those that it did, at random.

    Candidates come in the order of a permutation of 0..d-1 drawn for the client, j -> j * step + shift. Of its first
    n + int(n * r) at most n are chosen ones, so no others are needed, however large d is.
    """
    steps = permutation_steps(d)
    chosen = sets.select(*keys, "idx").withColumn("real", F.lit(True))
    sizes = chosen.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("extra", F.floor(F.col("n") * F.lit(r))).where("extra > 0")
    h = order_key(seed, *keys)
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    sizes = sizes.withColumn("step", F.get(F.array(*[F.lit(s).cast("long") for s in steps]), (part(1) % len(steps)).cast("int"))).withColumn("shift", part(9) % d)
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n") + F.col("extra"), F.lit(d)) - 1)).alias("j")
    free = sizes.select(*keys, "extra", "step", "shift", j).withColumn("idx", (F.col("j") * F.col("step") + F.col("shift")) % d)
    free = free.join(chosen.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    w = Window.partitionBy(*keys).orderBy("j")  # of one client, about what it chose
    added = free.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("extra")).select(*keys, "idx", F.lit(False).alias("real"))
    return chosen.unionByName(added)


def k_anonymous(sets: DataFrame, least: int = 5, keys: tuple[str, ...] = ("round",)) -> DataFrame:
    """Only the indices that at least so many participants of the round share."""
    from .aggregate import index_counts

    return sets.join(index_counts(sets, keys, least).select(*keys, "idx"), [*keys, "idx"], "left_semi")


def cache_lines(sets: DataFrame, width: int = 64, cell: int = 8) -> DataFrame:
    """Indices seen only as the memory line that they lie in; repeats and order stay."""
    return sets.withColumn("idx", F.expr(f"idx div {width // cell}"))


def ldp_perturbed(gradients: DataFrame, epsilon: float, bound: float, seed) -> DataFrame:
    """A random unit vector for each client, turned towards its gradient, within epsilon of local privacy.

    The gradient is clipped to bound and sent to +-bound along its direction, + with probability 1/2 + norm / (2 bound);
    a uniform direction gets the sign of its product with that, flipped with probability 1 / (e^epsilon + 1).
    Sums are fixed-point, so signs don't depend on their order.
    """
    z = gradients.withColumn("z", normal(seed, "client_id", "idx"))
    sums = z.groupBy("client_id").agg(
        (F.sum(micro(F.col("value") * F.col("value"))) / 1e6).alias("gg"),
        (F.sum(micro(F.col("z") * F.col("z"))) / 1e6).alias("zz"),
        (F.sum(micro(F.col("z") * F.col("value"))) / 1e6).alias("zg"),
    )
    norm = F.least(F.sqrt("gg"), F.lit(bound))
    first = F.when(uniform(f"{seed}f", "client_id") < 0.5 + norm / (2 * bound), 1.0).otherwise(-1.0)
    last = F.when(uniform(f"{seed}l", "client_id") > math.exp(epsilon) / (math.exp(epsilon) + 1), -1.0).otherwise(1.0)
    sums = sums.select("client_id", (F.signum("zg") * first * last / F.sqrt("zz")).alias("turn"))
    return z.join(sums, "client_id").select("client_id", "idx", (F.col("z") * F.col("turn")).alias("value"))


def l2_projection(vector: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """w / max(1, norm) * radius, by keys: onto the ball, and scaled by the radius inside it as well."""
    norm = vector.groupBy(*keys).agg(F.sqrt(F.sum(micro(F.col("value") * F.col("value"))) / 1e6).alias("norm"))
    both = vector.join(norm, list(keys)) if keys else vector.join(F.broadcast(norm))
    return both.select(*keys, "idx", (F.col("value") / F.greatest(F.lit(1.0), F.col("norm")) * F.lit(radius)).alias("value"))


def ldp_constants(d: int, epsilon: float, users: int, bound: float = 1.0) -> dict[str, float]:
    """Scale of the averaged perturbed gradients, radius of the parameter space and step size."""
    gamma = math.exp(math.lgamma((d - 1) / 2 + 1) - math.lgamma(d / 2 + 1))
    c = (math.exp(epsilon) + 1) / (math.exp(epsilon) - 1)
    radius = bound * c * 0.75 * math.sqrt(math.pi * d)
    return {"c_eps": c, "gradient_scale": bound * math.sqrt(math.pi) / 2 * gamma * c * d, "radius": radius, "rate": 0.05 * radius * math.sqrt(users) / (c * bound * math.sqrt(d))}


def server_step(vector: DataFrame, mean_gradient: DataFrame, rate: float, scale: float = 1.0, radius: float | None = None) -> DataFrame:
    """vector - rate * scale * gradient, then back onto the ball where there is one."""
    from .aggregate import applied

    out = applied(vector, mean_gradient, -rate * scale)
    return l2_projection(out, radius) if radius is not None else out


def step_rate(rate: float, round_no: int, every: int = 100, factor: float = 0.5) -> float:
    """The step size, cut by a factor every so many rounds."""
    return rate * factor ** (round_no // every)
