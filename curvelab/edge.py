"""Output normalisation, so that two engines can be compared value by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Values that stand exactly between two roundings (averages of cents, say) come out of two
#: engines a last bit above or below.  Queries over such values lift both sides by less than
#: any digit shown (``nudge``).
NUDGE = 1.0 + 1e-12


def clean(c: Column) -> Column:
    """Non-finite doubles become null."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def settle(df: DataFrame, dp: int = 6, nudge: bool = False, **per_column: int) -> DataFrame:
    """Round doubles, drop negative zero, and print dates and times as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(clean(c) * F.lit(NUDGE) if nudge else clean(c), per_column.get(field.name, dp)) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.BooleanType):
            c = c.cast("long")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def settle_sql(inner: str, keys: str, values: str = "", dp: int = 6, nudge: bool = False) -> str:
    """The same normalisation for a DuckDB query string."""
    names = [v.strip() for v in values.replace("\n", " ").split(",") if v.strip()]
    rounded = []
    for n in names:
        name, _, places = n.partition(":")
        rounded.append(f"round({name}::DOUBLE{f" * {NUDGE!r}" if nudge else ""}, {places or dp}) + 0.0 AS {name}")
    listed = ", ".join([k.strip() for k in keys.replace("\n", " ").split(",") if k.strip()] + rounded)
    return f"SELECT {listed} FROM (\n{inner}\n) settled"
