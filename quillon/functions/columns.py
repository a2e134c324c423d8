"""Scalar functions as Columns: guards, hashing, and closed forms that stay in generated code."""

from __future__ import annotations

import math
from functools import lru_cache
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import special


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def numeric(c: Column | str) -> Column:
    """A double, or null where the value isn't a number."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def all_of(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs)


def seeded_hex(seed: int, ident: Column | str) -> Column:
    """SHA-256 of `seed:id` in hex; its order is the order of the digests."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident) if isinstance(ident, str) else ident), 256)


def unsigned64(hexed: Column) -> Column:
    """The first eight bytes of a hex digest as an exact unsigned number."""
    return F.conv(F.substring(hexed, 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(hexed: Column) -> Column:
    """The first eight bytes of a hex digest over 2**64."""
    return unsigned64(hexed).cast("double") / F.lit(2.0**64)


def xlogx(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def abspow(x: Column, p: float) -> Column:
    """|x| to a power clipped to [-8, 8]; the base is floored for negative powers."""
    p = max(-8.0, min(8.0, p))
    base = F.abs(x) if p >= 0 else F.greatest(F.abs(x), F.lit(1e-12))
    return F.pow(base, F.lit(p))


def signpow(x: Column, p: float) -> Column:
    return F.signum(x) * abspow(x, p)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clipped(x, -40.0, 40.0)))


Z975 = 1.959963984540054


def t975(df: Column) -> Column:
    """The .975 quantile of Student's t: from a table of exact values up to 40 degrees of freedom, else the expansion in 1/df."""
    z = Z975
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    series = F.lit(z)
    for k, c in enumerate(terms, 1):
        series = series + F.lit(c) / F.pow(df, F.lit(float(k)))
    return F.when((df >= 1) & (df <= len(small_t())), F.element_at(F.array(*map(F.lit, small_t())), F.least(F.greatest(F.round(df), F.lit(1)), F.lit(len(small_t()))).cast("int"))).otherwise(series)


@lru_cache(maxsize=1)
def small_t() -> list[float]:
    """The .975 quantiles of Student's t for 1 to 40 degrees of freedom."""
    exact2 = 2 * 0.475 * math.sqrt(2 / (4 * 0.975 * 0.025))
    return [math.tan(math.pi * 0.475), exact2, *(float(special.t_ppf(0.975, float(k))) for k in range(3, 41))]


def poly(coefficients: list[tuple[float, tuple[int, ...]]], xs: list[Column]) -> Column:
    """Sum of coefficient times product of powers."""
    total = F.lit(0.0)
    for c, powers in coefficients:
        term = F.lit(float(c))
        for x, k in zip(xs, powers, strict=True):
            for _ in range(k):
                term = term * x
        total = total + term
    return total
