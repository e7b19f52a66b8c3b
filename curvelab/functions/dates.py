"""Calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Futures month codes, January to December.
MONTH_CODES = "FGHJKMNQUVXZ"
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
# First day of each month on the leap axis (366 days) and the plain axis (365 days).
LEAP_BOUNDARIES = (1, 32, 61, 92, 122, 153, 183, 214, 245, 275, 306, 336, 367)
PLAIN_BOUNDARIES = (1, 32, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335, 366)

MONDAY = "1970-01-05"


def delivery_index(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month) - 1


def month_code(month: Column) -> Column:
    return F.substring(F.lit(MONTH_CODES), F.month(month), F.lit(1))


def month_from_code(code: Column) -> Column:
    return F.nullif(F.instr(F.lit(MONTH_CODES), code), F.lit(0))


def month_name(number: Column) -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.when(number.between(1, 12), F.get(names, number.cast("int") - 1))


def weekday(day: Column) -> Column:
    """Monday is 1."""
    return F.weekday(day) + 1


def _weekdays_before(day: Column) -> Column:
    n = F.datediff(day, F.lit(MONDAY).cast("date"))
    return F.floor(n / F.lit(7)) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days(start: Column, end: Column) -> Column:
    """Monday-to-Friday days in [start, end); zero where the end is not later."""
    return F.when(end <= start, F.lit(0)).otherwise(_weekdays_before(end) - _weekdays_before(start)).cast("int")


def is_leap(day: Column) -> Column:
    y = F.year(day)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def leap_axis_day(day: Column) -> Column:
    """Day of the year on a 366-day axis where every month/day has one slot."""
    return F.dayofyear(day) + F.when(~is_leap(day) & (F.month(day) > 2), 1).otherwise(0)


def nearest_reference(day: Column, delivery_month: Column, contract_year: Column) -> Column:
    """1 for the next delivery of this month, 2 for the one a year later, and so on."""
    nearest = F.year(day) + F.when(F.month(day) >= delivery_month, 1).otherwise(0)
    return contract_year - nearest + 1


def plot_year(day: Column, reference: Column, roll_month: Column) -> Column:
    return F.year(day) + reference - 1 + F.when(F.month(day) >= roll_month, 1).otherwise(0)


def season_axis_day(day: Column, plotted_year: Column, reference: Column, roll_month: Column) -> Column:
    """Leap-axis day, moved one cycle on in the year the cycle ends."""
    base = leap_axis_day(day)
    ends_here = (roll_month > 1) & (F.year(day) == plotted_year - (reference - 1))
    return F.when(ends_here, base + 366).otherwise(base)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def previous_weekday(day: Column) -> Column:
    w = F.weekday(day)
    return F.date_sub(day, F.when(w >= 5, w - 4).otherwise(0).cast("int"))


def weekday_offset(day: Column, n: int) -> Column:
    """Step ``n`` Monday-to-Friday days back from a weekday (``n`` up to 4)."""
    w = F.weekday(day)
    return F.date_sub(day, (F.lit(n) + F.when(w < n, 2).otherwise(0)).cast("int"))


def expand_year(text: Column, reference_year: Column | int) -> Column:
    """One digit: within five years of the reference; two digits: pivot 70; four: as is."""
    ref = F.lit(reference_year) if isinstance(reference_year, int) else reference_year
    number = text.cast("int")
    near = _div(ref, 10) * 10 + number
    one = F.when(near < ref - 5, near + 10).when(near > ref + 5, near - 10).otherwise(near)
    two = F.when(number >= 70, number + 1900).otherwise(number + 2000)
    size = F.length(text)
    return F.when(size == 1, one).when(size == 2, two).when(size == 4, number)
