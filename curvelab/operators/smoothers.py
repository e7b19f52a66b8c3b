"""Recursive smoothers as window expressions.

``y[t] = (1-a) y[t-1] + a x[t]`` is linear in the starting value, so inside one block

    y[t] = P[t] * (y0 + sum(B[i] / P[i] for i <= t))

with ``P`` the running product of the decay factors.  Inside a block that is one
running sum; between blocks the halo supplies the start, whose weight falls below
double precision after ``seed_rows(a)`` rows.  Nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelab.functions.stats import seed_rows
from curvelab.scale import ROW, Blocked

# exp() must stay inside the double range over one halo-extended block.
_EXPONENT_LIMIT = 650.0


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def check_block(alphas: list[float], halo: int, block: int) -> None:
    """The block must be short enough for the scaled sums and the halo long enough to seed."""
    for a in alphas:
        if a < 1 and (block + halo) * -math.log1p(-a) > _EXPONENT_LIMIT:
            raise ValueError(f"block of {block} rows is too long for alpha {a}")
        if seed_rows(a) > halo:
            raise ValueError(f"alpha {a} needs a halo of {seed_rows(a)} rows")


def block_for(alphas: list[float], halo: int, wanted: int = 4096) -> int:
    """Largest block up to ``wanted`` whose scaled sums stay in range."""
    steepest = max((-math.log1p(-a) for a in alphas if a < 1), default=0.0)
    room = int(_EXPONENT_LIMIT / steepest) - halo if steepest else wanted
    if room < 1:
        raise ValueError("no block length satisfies both the seed and the exponent range")
    return min(wanted, room)


def smooth(b: Blocked, x: Column, alpha: float, minimum: int = 1) -> Column:
    """Exponential mean of a series without nulls, null before ``minimum`` rows."""
    start = F.min(ROW).over(b.running)
    k = F.col(ROW) - start
    decay = math.log1p(-alpha)
    term = F.when(k == 0, x).otherwise(F.lit(alpha) * x * F.exp(-k * F.lit(decay)))
    value = F.sum(term).over(b.running) * F.exp(k * F.lit(decay))
    return F.when(F.col(ROW) >= minimum, value)


def smooth_nullable(
    b: Blocked, df: DataFrame, x: str, alpha: float, name: str, minimum: int = 1
) -> DataFrame:
    """Exponential mean where ``x`` may be null.

    A gap decays by its length (weights follow absolute positions) and the last value
    is carried over the gap.
    """
    before = b.order.rowsBetween(Window.unboundedPreceding, -1)
    xs = F.col(x)
    last_seen = F.last(F.when(xs.isNotNull(), F.col(ROW)), ignorenulls=True).over(before)
    held = F.exp((F.col(ROW) - F.col("_seen")) * F.lit(math.log1p(-alpha)))
    weight = held + F.lit(alpha)
    is_first = xs.isNotNull() & F.col("_seen").isNull()
    return (
        df.withColumn("_seen", last_seen)
        .withColumn("_lnA", F.when(xs.isNotNull() & ~is_first, F.log(held / weight)).otherwise(0.0))
        .withColumn("_lnP", F.sum("_lnA").over(b.running))
        .withColumn(
            "_term",
            F.when(is_first, xs).when(xs.isNotNull(), F.lit(alpha) * xs / weight * F.exp(-F.col("_lnP"))),
        )
        .withColumn(
            name,
            F.when(F.count(xs).over(b.running) >= minimum, F.sum("_term").over(b.running) * F.exp(F.col("_lnP"))),
        )
        .drop("_seen", "_lnA", "_lnP", "_term")
    )


def rsi(gain: Column, loss: Column) -> Column:
    """100 where there was no loss."""
    safe = F.nullif(loss, F.lit(0.0))
    return F.when(loss == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + gain / safe))
