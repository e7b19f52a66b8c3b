"""Rolling moments from running sums.

A sliding Spark frame is evaluated from scratch for every row, which costs the window
length per row and statistic.  A running frame is updated row by row.  A trailing window
is the difference of two running sums, so each statistic costs one running sum and one
look-back, whatever the window length.  Blocks keep the running sums short.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.scale import Blocked

# Below this share of the running square sum a window's square sum is rounding noise.
_NOISE = 1e-13


@dataclass(frozen=True)
class Track:
    """A series, the highest power to sum, and the window lengths wanted."""

    value: Column
    windows: Sequence[int]
    powers: int = 1


def window_sums(b: Blocked, df: DataFrame, series: Mapping[str, Track]) -> DataFrame:
    """Adds ``{name}_n{w}`` counts and ``{name}_{power}w{w}`` power sums per window.

    The many small expressions are written as SQL text: one parse instead of one
    Python call per operator.
    """
    over_running = f"OVER {b.sql} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    over = f"OVER {b.sql})"
    running: dict[str, str] = {}
    for name, t in series.items():
        if max(t.windows) > b.halo:
            raise ValueError(f"{name}: window {max(t.windows)} is longer than the halo {b.halo}")
        running[f"_{name}_n"] = f"count(_{name}_v) {over_running}"
        for k in range(1, t.powers + 1):
            power = " * ".join([f"_{name}_v"] * k)
            running[f"_{name}_{k}"] = f"coalesce(sum({power}) {over_running}, 0D)"
    windows: dict[str, str] = {}
    for name, t in series.items():
        for w in t.windows:
            for part in ("n", *map(str, range(1, t.powers + 1))):
                total = f"_{name}_{part}"
                out = f"{name}_n{w}" if part == "n" else f"{name}_{part}w{w}"
                windows[out] = f"{total} - coalesce(lag({total}, {w}) {over}, 0)"
        if t.powers >= 2:
            windows[f"{name}_floor"] = f"_{name}_2 * {_NOISE!r}D"
    kept = [f"`{c}`" for c in df.columns]
    valued = df.withColumns({f"_{name}_v": t.value for name, t in series.items()})
    summed = valued.selectExpr(*kept, *[f"{e} AS {c}" for c, e in running.items()])
    return summed.selectExpr(*kept, *[f"{e} AS {c}" for c, e in windows.items()])


def _mean(name: str, w: int, power: int = 1) -> str:
    return f"({name}_{power}w{w} / nullif({name}_n{w}, 0))"


def _squares(name: str, w: int) -> str:
    """Sum of squared deviations, with rounding noise cut to zero."""
    raw = f"({name}_2w{w} - {name}_1w{w} * {name}_1w{w} / nullif({name}_n{w}, 0))"
    return f"(CASE WHEN {raw} > {name}_floor THEN {raw} WHEN {raw} IS NOT NULL THEN 0D END)"


def _var(name: str, w: int, minimum: int) -> str:
    return f"(CASE WHEN {name}_n{w} >= {max(minimum, 2)} THEN {_squares(name, w)} / ({name}_n{w} - 1) END)"


def total(name: str, w: int, minimum: int, power: int = 1) -> Column:
    return F.expr(f"CASE WHEN {name}_n{w} >= {minimum} THEN {name}_{power}w{w} END")


def mean(name: str, w: int, minimum: int, power: int = 1) -> Column:
    return F.expr(f"CASE WHEN {name}_n{w} >= {minimum} THEN {_mean(name, w, power)} END")


def var(name: str, w: int, minimum: int) -> Column:
    return F.expr(_var(name, w, minimum))


def std(name: str, w: int, minimum: int) -> Column:
    return F.expr(f"sqrt({_var(name, w, minimum)})")


def skew(name: str, w: int, minimum: int) -> Column:
    """Bias-corrected skewness; null where the window is flat."""
    n, m, s2, s3 = f"double({name}_n{w})", _mean(name, w), _mean(name, w, 2), _mean(name, w, 3)
    m2 = f"nullif({_squares(name, w)} / {name}_n{w}, 0D)"
    m3 = f"({s3} - 3 * {m} * {s2} + 2 * {m} * {m} * {m})"
    return F.expr(
        f"CASE WHEN {name}_n{w} >= {max(minimum, 3)} THEN {m3} / ({m2} * sqrt({m2})) * sqrt({n} * ({n} - 1)) / ({n} - 2) END"
    )


def kurtosis(name: str, w: int, minimum: int) -> Column:
    """Bias-corrected excess kurtosis; null where the window is flat."""
    n, m = f"double({name}_n{w})", _mean(name, w)
    s2, s3, s4 = (_mean(name, w, k) for k in (2, 3, 4))
    m2 = f"nullif({_squares(name, w)} / {name}_n{w}, 0D)"
    m4 = f"({s4} - 4 * {m} * {s3} + 6 * {m} * {m} * {s2} - 3 * {m} * {m} * {m} * {m})"
    return F.expr(
        f"CASE WHEN {name}_n{w} >= {max(minimum, 4)} THEN"
        f" ({n} - 1) * (({n} + 1) * ({m4} / ({m2} * {m2}) - 3) + 6) / (({n} - 2) * ({n} - 3)) END"
    )


def pair_tracks(name: str, x: str, y: str, w: int) -> dict[str, Track]:
    """The sums a correlation needs, over rows where both values exist."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return {
        f"{name}x": Track(F.expr(f"CASE WHEN {both} THEN {x} END"), (w,), 2),
        f"{name}y": Track(F.expr(f"CASE WHEN {both} THEN {y} END"), (w,), 2),
        f"{name}xy": Track(F.expr(f"{x} * {y}"), (w,), 1),
    }


def correlation(name: str, w: int, minimum: int) -> Column:
    n = f"nullif({name}x_n{w}, 0)"
    cross = f"({name}xy_1w{w} - {name}x_1w{w} * {name}y_1w{w} / {n})"
    scale = f"nullif(sqrt({_squares(f'{name}x', w)}) * sqrt({_squares(f'{name}y', w)}), 0D)"
    return F.expr(f"CASE WHEN {name}x_n{w} >= {minimum} THEN {cross} / {scale} END")


def tracked_columns(series: Mapping[str, Track]) -> list[str]:
    """All helper columns ``window_sums`` adds, for dropping."""
    out = []
    for name, t in series.items():
        for w in t.windows:
            out.append(f"{name}_n{w}")
            out += [f"{name}_{k}w{w}" for k in range(1, t.powers + 1)]
        if t.powers >= 2:
            out.append(f"{name}_floor")
    return out
