"""Building blocks that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy(entity)`` sends every row of an entity to one task.
Here an entity's ordered rows are numbered with a two-level count and then cut
into blocks of bounded size.  Each block carries a halo of the rows before it, as
many as the longest look-back needs, so every trailing row window gives the same
value it would give on the unbroken series.  Running totals use two levels: totals
per (key, bucket), a prefix over the small totals table, then a running value
inside the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_blk"
HALO = "_halo"
ROW = "_rn"
_BUCKET = "_bucket"
_BEFORE = "_before"
_PLACE = "_place"


def _cols(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _place(keys: Sequence[str]) -> Column:
    """Keys and bucket as one struct: equal where the same of them are null, so no row is lost in a join."""
    return F.struct(*keys, _BUCKET).alias(_PLACE)


def row_index(
    df: DataFrame,
    entity: Sequence[str] | str,
    order: Sequence[str | Column] | str,
    bucket: Column,
    name: str = ROW,
    base: DataFrame | None = None,
) -> DataFrame:
    """1-based row number per entity without gathering an entity in one task.

    ``bucket`` must be monotone in the order (for example the month of the bar
    time).  Counts per (entity, bucket) are combined map-side; only that small table
    is prefix-summed per entity; the final numbering happens inside a bucket.

    ``base`` is a stored table with the same rows as ``df`` before columns were
    added.  The counts then scan its keys only and nothing upstream runs twice.
    """
    keys = _cols(entity)
    by = [order] if isinstance(order, (str, Column)) else list(order)
    bucketed = df.withColumn(_BUCKET, bucket)
    counted = bucketed if base is None else base.withColumn(_BUCKET, bucket)
    counts = counted.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _place(keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_BEFORE)
    )
    inside = Window.partitionBy(_PLACE).orderBy(*by)
    return (
        bucketed.withColumn(_PLACE, _place(keys))
        .join(offsets, _PLACE)
        .withColumn(name, F.col(_BEFORE) + F.row_number().over(inside))
        .drop(_BUCKET, _BEFORE, _PLACE)
    )


@dataclass(frozen=True)
class Blocked:
    """A frame cut into halo-extended blocks, with the window specs that fit it."""

    frame: DataFrame
    keys: tuple[str, ...]
    halo: int

    @cached_property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(ROW)

    @property
    def sql(self) -> str:
        """The same window as SQL text, without its closing parenthesis."""
        return f"(PARTITION BY {', '.join((*self.keys, BLOCK))} ORDER BY {ROW}"

    def trailing(self, rows: int) -> WindowSpec:
        """The current row and the ``rows - 1`` rows before it."""
        self._check(rows)
        return self.order.rowsBetween(-(rows - 1), 0)

    def prior(self, rows: int) -> WindowSpec:
        """The ``rows`` rows strictly before the current one."""
        self._check(rows)
        return self.order.rowsBetween(-rows, -1)

    @cached_property
    def running(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, 0)

    def focus(self, df: DataFrame, *inputs: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """``focus`` with the block columns always kept."""
        return focus(df, [*self.keys, BLOCK, ROW, HALO, *inputs])

    def _check(self, rows: int) -> None:
        if rows > self.halo + 1:
            raise ValueError(f"window of {rows} rows needs a halo of at least {rows - 1}")

    def finish(self, frame: DataFrame, *drop: str) -> DataFrame:
        """Drop the halo copies (every source row stays exactly once)."""
        return frame.filter(~F.col(HALO)).drop(BLOCK, HALO, ROW, *drop)


def blocked(
    df: DataFrame,
    entity: Sequence[str] | str,
    order: Sequence[str | Column] | str,
    bucket: Column,
    halo: int,
    block: int = 4096,
    base: DataFrame | None = None,
) -> Blocked:
    """Cut every entity into blocks of ``block`` rows plus ``halo`` earlier rows.

    ``halo`` is the sum of look-backs along the longest chain of dependent windows.
    """
    keys = _cols(entity)
    indexed = row_index(df, keys, order, bucket, base=base)
    own = F.floor((F.col(ROW) - 1) / F.lit(block))
    last = F.floor((F.col(ROW) - 1 + F.lit(halo)) / F.lit(block))
    frame = (
        indexed.withColumn("_own", own)
        .withColumn(BLOCK, F.explode(F.sequence(F.col("_own"), last)))
        .withColumn(HALO, F.col(BLOCK) > F.col("_own"))
        .drop("_own")
    )
    return Blocked(frame, tuple(keys), halo)


def running_total(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str | Column] | str,
    bucket: Column,
    totals: dict[str, Column],
    base: DataFrame | None = None,
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Unbounded running sums per key as a two-level prefix sum.

    ``base`` as in ``row_index``; the summed expressions must exist on it.  ``whole``
    asks for the complete sum of a total as one more column, from the same small table.
    """
    keys = _cols(keys)
    by = [order] if isinstance(order, (str, Column)) else list(order)
    parts = {name: f"_part_{i}" for i, name in enumerate(totals)}

    def with_parts(frame: DataFrame) -> DataFrame:
        return frame.withColumns({_BUCKET: bucket, **{parts[n]: e for n, e in totals.items()}})

    work = with_parts(df)
    summed = work if base is None else with_parts(base)
    sums = summed.groupBy(*keys, _BUCKET).agg(*[F.sum(p).alias(f"{p}_t") for p in parts.values()])
    per_key = Window.partitionBy(*keys).orderBy(_BUCKET)
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    everything = per_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        _place(keys),
        *[F.coalesce(F.sum(f"{p}_t").over(before), F.lit(0.0)).alias(f"{p}_b") for p in parts.values()],
        *[
            F.coalesce(F.sum(f"{parts[n]}_t").over(everything), F.lit(0.0)).alias(alias)
            for n, alias in (whole or {}).items()
        ],
    )
    inside = Window.partitionBy(_PLACE).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        work.withColumn(_PLACE, _place(keys))
        .join(offsets, _PLACE)
        .withColumns(
            {n: F.col(f"{p}_b") + F.coalesce(F.sum(p).over(inside), F.lit(0.0)) for n, p in parts.items()}
        )
        .drop(_BUCKET, _PLACE, *parts.values(), *[f"{p}_b" for p in parts.values()])
    )


def last_known(df: DataFrame, keys: Sequence[str] | str, order: str, bucket: Column, value: str) -> DataFrame:
    """``value`` carried forward over its nulls, as a two-level scan.

    The last value of each (key, bucket) is an aggregate, the last one before a bucket a scan
    of that small table, and only the rest happens inside a bucket.
    """
    keys = _cols(keys)
    work = df.withColumn(_BUCKET, bucket)
    known = work.filter(F.col(value).isNotNull()).groupBy(*keys, _BUCKET).agg(F.max_by(value, order).alias("_last"))
    places = work.select(*keys, _BUCKET).distinct().withColumn(_PLACE, _place(keys))
    every = places.join(known.select(_place(keys), "_last"), _PLACE, "left")
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.select(_PLACE, F.last("_last", ignorenulls=True).over(before).alias(_BEFORE))
    inside = Window.partitionBy(_PLACE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        work.withColumn(_PLACE, _place(keys))
        .join(offsets, _PLACE)
        .withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col(_BEFORE)))
        .drop(_BUCKET, _BEFORE, _PLACE)
    )


def latest_by(df: DataFrame, keys: Sequence[str] | str, *order: str | Column) -> DataFrame:
    """The last row per key.  An aggregate, so rows are combined before the shuffle."""
    keys = _cols(keys)
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else (F.col(order[0]) if isinstance(order[0], str) else order[0])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others])


def keep_last(df: DataFrame, keys: Sequence[str] | str, seq: str) -> DataFrame:
    """Upsert semantics: of all versions of a key the one ingested last stays."""
    return latest_by(df, keys, seq)


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str] | str, how: str = "left", salts: int = 16
) -> DataFrame:
    """Join a table with hot keys to a table unique per key.

    The rows of a hot key spread over ``salts`` tasks; the unique side is repeated
    ``salts`` times, which stays small because it holds one row per key.
    """
    names = _cols(keys)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int")
    # Key and salt as one value: a side that is placed by the keys alone already, such as the
    # result of an aggregate, would otherwise bring all rows of a key together again.  Values
    # that contain nulls are equal to each other, so null keys of the small side are left out.
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in names])
    spread = big.withColumn("_salted", F.struct(*names, salt.alias("_salt")))
    copies = (
        small.filter(known)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .withColumn("_salted", F.struct(*names, "_salt"))
        .drop("_salt", *names)
    )
    return spread.join(copies, "_salted", how).drop("_salted")


def top_rows(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark limits each task before the shuffle."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Schema-tolerant union: a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def focus(df: DataFrame, inputs: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Keep ``inputs`` as columns and carry all other columns in one struct.

    Every window operator copies its whole input row field by field.  A chain of window
    stages over a wide row pays that copy in each stage; a struct is copied as one block
    of bytes.  The returned function opens the struct again beside the new columns.
    """
    wanted = [c for c in dict.fromkeys(inputs) if c in df.columns]
    others = [c for c in df.columns if c not in set(wanted)]
    if not others:
        return df, lambda out: out
    packed = df.select(*wanted, F.struct(*others).alias("_rest"))

    def restore(out: DataFrame) -> DataFrame:
        return out.select("_rest.*", *[c for c in out.columns if c != "_rest"])

    return packed, restore
