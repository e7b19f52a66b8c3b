"""Window extremes with minimum counts, and a few closed-form functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

HALF_PI = math.pi / 2.0


def low(x: Column, w: WindowSpec, minimum: int) -> Column:
    return F.when(F.count(x).over(w) >= minimum, F.min(x).over(w))


def high(x: Column, w: WindowSpec, minimum: int) -> Column:
    return F.when(F.count(x).over(w) >= minimum, F.max(x).over(w))


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear quantile of a sorted array column."""
    n = F.size(values)
    at = (n - 1) * F.lit(q)
    lower = F.floor(at).cast("int")
    a = F.get(values, lower)
    b = F.get(values, F.least(lower + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (at - lower))


def clip(x: Column, lowest: float | None = None, highest: float | None = None) -> Column:
    """Bounded value; null stays null."""
    out = x
    if highest is not None:
        out = F.when(out > highest, F.lit(float(highest))).otherwise(out)
    if lowest is not None:
        out = F.when(out < lowest, F.lit(float(lowest))).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """Division that gives null instead of an error or an infinity."""
    return F.try_divide(a, b)


def significant(x: Column, digits: int = 10) -> Column:
    """The value in so many digits: sums of the same numbers in another order become equal."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double"))


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


# Rational approximation of the normal integral (Hart's coefficients).
_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(z: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * z + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as one codegen expression."""
    z = F.abs(x)
    density = F.exp(-z * z / 2)
    body = density * _horner(z, _TOP) / _horner(z, _BOTTOM)
    far = density / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + F.lit(0.65)))))) / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, body).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same approximation as a DuckDB expression."""
    z = f"abs({x})"

    def poly(cs: tuple[float, ...]) -> str:
        text = repr(cs[0])
        for c in cs[1:]:
            text = f"({text}*{z}+{c!r})"
        return text

    body = f"exp(-{z}*{z}/2)*{poly(_TOP)}/{poly(_BOTTOM)}"
    far = (
        f"exp(-{z}*{z}/2)/({z}+1/({z}+2/({z}+3/({z}+4/({z}+0.65)))))/{math.sqrt(2 * math.pi)!r}"
    )
    tail = f"CASE WHEN {z}>37 THEN 0 WHEN {z}<7.07106781186547 THEN {body} ELSE {far} END"
    return f"CASE WHEN {x}>0 THEN 1-({tail}) ELSE ({tail}) END"


def expected_maximum_factor(trials: int) -> float:
    """Expected largest of ``trials`` standard normals, in standard errors."""
    n = max(2, int(trials))
    gamma = 0.5772156649015329
    q = NormalDist().inv_cdf
    return (1 - gamma) * q(1 - 1 / n) + gamma * q(1 - 1 / (n * math.e))


def seed_rows(alpha: float) -> int:
    """Rows after which the starting value of a smoother is below double precision."""
    return math.ceil(60 * math.log(2) / -math.log1p(-alpha)) if alpha < 1 else 1
