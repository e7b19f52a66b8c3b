"""Unit names, unit conversion through USD per gallon, and display rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvelab.config import DEFAULT_BBL_PER_MT, DEFAULT_GAL_PER_BBL

# Accepted spellings per unit.
UNIT_SPELLINGS = {
    "cpg": ("cpg", "cents/gal", "cents/gallon"),
    "$/gal": ("$/gal", "usd/gal", "$/gallon", "usd/gallon"),
    "$/bbl": ("$/bbl", "usd/bbl", "$/barrel", "usd/barrel"),
    "$/MT": ("$/mt", "usd/mt", "$/metricton", "usd/metricton"),
}
UNITS = tuple(UNIT_SPELLINGS)
FLAT_CURVE_SPELLINGS = ("flat", "flatforward", "monthless", "spot")


def finite(x: Column) -> Column:
    """Numeric value, or null for text that is no number, NaN and infinities."""
    # NaN is above infinity in Spark's order.
    number = x.try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def display_round(x: Column, places: int = 5) -> Column:
    """Half away from zero at up to five places, never negative zero."""
    return F.round(finite(x), max(0, min(5, places))) + F.lit(0.0)


def unit_name(text: Column) -> Column:
    # A lookup evaluates the text once; a chain of tests would clean it anew for each.
    key = F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", ""))
    names = F.create_map(*[F.lit(x) for unit, spellings in UNIT_SPELLINGS.items() for s in spellings for x in (s, unit)])
    return F.coalesce(F.try_element_at(names, key), F.lit(""))


def curve_mode(text: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[\s_-]+", ""))
    return F.when(key.isin(*FLAT_CURVE_SPELLINGS), F.lit("flat")).otherwise(F.lit("monthly"))


def _factor(x: Column | None, default: float) -> Column:
    if x is None:
        return F.lit(default)
    x = finite(x)
    return F.when(x > 0, x).otherwise(F.lit(default))


def usd_per_gallon_factor(unit: Column, bbl_per_mt: Column | None, gal_per_bbl: Column | None) -> Column:
    """How many native units make one USD per gallon."""
    gal = _factor(gal_per_bbl, DEFAULT_GAL_PER_BBL)
    mt = _factor(bbl_per_mt, DEFAULT_BBL_PER_MT)
    place = F.nullif(F.array_position(F.array(*[F.lit(u) for u in UNITS]), unit), F.lit(0)).cast("int")
    return F.try_element_at(F.array(F.lit(100.0), F.lit(1.0), gal, gal * mt), place)


def convert(
    value: Column,
    source: Column,
    target: Column,
    bbl_per_mt: Column | None = None,
    gal_per_bbl: Column | None = None,
) -> Column:
    """Convert between cpg, $/gal, $/bbl and $/MT; null for an unknown unit."""
    a, b = unit_name(source), unit_name(target)
    number = finite(value)
    per_gallon = number / usd_per_gallon_factor(a, bbl_per_mt, gal_per_bbl)
    moved = per_gallon * usd_per_gallon_factor(b, bbl_per_mt, gal_per_bbl)
    return F.when((a != "") & (b != ""), display_round(F.when(a == b, number).otherwise(moved)))
