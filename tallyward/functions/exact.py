"""Expressions that give the same value on any engine and in any order: fixed-point sums, seeded uniforms and normals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1e6


def micro(value) -> Column:
    """A value in whole millionths; sums of these don't depend on their order."""
    return F.floor(_c(value).cast("double") * MICRO + 0.5).cast("long")


def rounded(value) -> Column:
    """Six decimals, half up, by the same arithmetic everywhere (unlike round())."""
    return F.floor(_c(value) * MICRO + 0.5) / MICRO


def order_key(seed, *ids) -> Column:
    """A string that orders rows at random, always alike for a seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(i).cast("string") for i in ids]).cast("binary"))


def uniform(seed, *ids) -> Column:
    """In [0, 1): the first 52 bits of the order key."""
    return F.conv(F.substring(order_key(seed, *ids), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def open_uniform(seed, *ids) -> Column:
    """In (0, 1), so that its logarithm is finite."""
    return F.greatest(uniform(seed, *ids), F.lit(2.0**-52))


def normal(seed, *ids) -> Column:
    """Standard normal, by Box and Muller from two uniforms."""
    return F.sqrt(-2.0 * F.log(open_uniform(f"{seed}a", *ids))) * F.cos(2.0 * math.pi * uniform(f"{seed}b", *ids))


def laplace(seed, scale: float, *ids) -> Column:
    """Laplace noise by inverting the distribution function."""
    p = open_uniform(seed, *ids)
    return F.when(p > 0.5, -scale * F.log(2.0 - 2.0 * p)).otherwise(scale * F.log(2.0 * p))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Duck:
    """The same expressions in the SQL that checks the results."""

    @staticmethod
    def micro(v: str) -> str:
        return f"floor(({v})::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT"

    @staticmethod
    def rounded(v: str) -> str:
        return f"(floor(({v}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE)"

    @staticmethod
    def order_key(seed, *ids: str) -> str:
        return f"md5('{seed}'" + "".join(f" || '|' || ({i})::VARCHAR" for i in ids) + ")"

    @classmethod
    def uniform(cls, seed, *ids: str) -> str:
        return f"(('0x' || substr({cls.order_key(seed, *ids)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

    @classmethod
    def open_uniform(cls, seed, *ids: str) -> str:
        return f"greatest({cls.uniform(seed, *ids)}, {2.0**-52!r}::DOUBLE)"

    @classmethod
    def normal(cls, seed, *ids: str) -> str:
        return f"(sqrt(-2.0::DOUBLE * ln({cls.open_uniform(f'{seed}a', *ids)})) * cos({2.0 * math.pi!r}::DOUBLE * {cls.uniform(f'{seed}b', *ids)}))"

    @classmethod
    def laplace(cls, seed, scale: float, *ids: str) -> str:
        p = cls.open_uniform(seed, *ids)
        return f"(CASE WHEN {p} > 0.5 THEN {-scale!r}::DOUBLE * ln(2.0::DOUBLE - 2.0::DOUBLE * {p}) ELSE {scale!r}::DOUBLE * ln(2.0::DOUBLE * {p}) END)"
