"""Contract tokens, tickers, periods and frequencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvelab.functions.dates import MONTH_CODES, MONTH_NAMES, month_from_code, month_name

# Period spellings, members and roll months.
QUARTERS = {f"Q{q}": (f"Q{q}", f"QUARTER {q}", f"QUARTER{q}") for q in (1, 2, 3, 4)}
HALVES = {f"Half {h}": (f"H{h}", f"{h}H", f"S{h}", f"HALF {h}", f"HALF{h}") for h in (1, 2)}
ROLL_MONTHS = {"Q1": 1, "Q2": 4, "Q3": 7, "Q4": 10, "Half 1": 1, "Half 2": 7}

_NAMES = "|".join(n.upper() for n in MONTH_NAMES)


def _text(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def _group(text: Column, pattern: str, group: int) -> Column:
    """Matched group, or null where the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def period_label(x: Column) -> Column:
    """Month name, quarter or half; other text stays as it is."""
    text = _text(x)
    upper = F.trim(F.regexp_replace(F.translate(F.upper(text), "-_", "  "), r"\s+", " "))
    out = F.when(text == "", F.lit(""))
    for label, spellings in {**QUARTERS, **HALVES}.items():
        out = out.when(upper.isin(*spellings), F.lit(label))
    for name in MONTH_NAMES:
        out = out.when(F.substring(upper, 1, 3) == name.upper(), F.lit(name))
    return out.otherwise(text)


def frequency_label(x: Column) -> Column:
    text = _text(x)
    upper = F.upper(text)
    return (
        F.when(text == "", F.lit(""))
        .when(upper.contains("QUART") | upper.startswith("Q"), F.lit("Quarterly"))
        .when(upper.contains("HALF") | upper.startswith("H") | upper.startswith("S"), F.lit("Half"))
        .when(upper.contains("MONTH"), F.lit("Monthly"))
        .otherwise(F.initcap(F.lower(text)))
    )


def reference_number(x: Column) -> Column:
    n = F.floor(x.try_cast("double")).cast("int")
    return F.when(n >= 1, n).otherwise(F.lit(1))


def month_number(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, name in enumerate(MONTH_NAMES, start=1):
        out = out.when(label == name, F.lit(i))
    return out


def roll_month(label: Column) -> Column:
    """Delivery month of a period: its own month, or the first of a quarter or half."""
    period = period_label(label)
    out = month_number(period)
    for name, number in ROLL_MONTHS.items():
        out = out.when(period == name, F.lit(number))
    return out


def quarter_of(label: Column) -> Column:
    return F.concat(F.lit("Q"), F.ceil(month_number(label) / F.lit(3)).cast("string"))


def half_of(label: Column) -> Column:
    return F.concat(F.lit("Half "), F.ceil(month_number(label) / F.lit(6)).cast("string"))


def first_token(x: Column) -> Column:
    return F.upper(F.regexp_extract(_text(x), r"^(\S+)", 1))


def contract_month(x: Column) -> Column:
    """Month name named by a contract text such as ``Jan 25``, ``JAN25``, ``HOF25`` or ``F25``."""
    text, token = F.upper(_text(x)), first_token(x)
    spaced = _group(text, rf"^({_NAMES})\s+(\d{{1,4}})$", 1)
    joined = _group(token, rf"^({_NAMES})(\d{{1,2}})$", 1)
    coded = F.coalesce(
        _group(token, rf"^[A-Z]{{1,4}}([{MONTH_CODES}])(\d{{1,2}})$", 1),
        _group(token, rf"^([{MONTH_CODES}])(\d{{1,2}})$", 1),
    )
    return F.coalesce(F.initcap(F.lower(F.coalesce(spaced, joined))), month_name(month_from_code(coded)))


def contract_year(x: Column) -> Column:
    """Contract year with the two-digit pivot at 70."""
    text, token = F.upper(_text(x)), first_token(x)
    digits = F.coalesce(
        F.right(_group(text, rf"^({_NAMES})\s+(\d{{1,4}})$", 2), F.lit(2)),
        _group(token, rf"^({_NAMES})(\d{{1,2}})$", 2),
        _group(token, rf"^[A-Z]{{1,4}}([{MONTH_CODES}])(\d{{1,2}})$", 2),
        _group(token, rf"^([{MONTH_CODES}])(\d{{1,2}})$", 2),
        _group(token, r"(\d{1,4})$", 1),
    )
    n = digits.try_cast("int")
    return F.when(n < 70, n + 2000).when(n < 100, n + 1900).otherwise(n)


def root_code(x: Column) -> Column:
    """Root part of a security name."""
    token = first_token(x)
    return F.coalesce(
        _group(token, rf"^([A-Z]{{1,4}})(?:[{MONTH_CODES}]|{_NAMES})\d{{1,2}}$", 1),
        _group(token, r"^([A-Z]+)", 1),
        _text(x),
    )


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` tokens and squeeze white space."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def ticker(template: Column, root: Column, code: Column, year: Column, yellow_key: Column, one: Column, two: Column) -> Column:
    """Ticker text; ``one`` and ``two`` are the year texts used for short year tokens."""
    return fill_template(
        template,
        {
            "root": root, "month_code": code, "yellow_key": yellow_key,
            "y": one, "year_1d": one, "year_digit": one, "yy": two, "year_2d": two,
            "year": year, "yyyy": year,
        },
    )


def parse_ticker(x: Column, reference_year: Column | int, root_hint: Column | None = None) -> Column:
    """Struct(root, month_code, month, year, yellow_key) of a ticker; null where it has no contract."""
    from curvelab.functions.dates import expand_year

    text = _text(x)
    key_pattern = r"(?i)\s+(Comdty|Index|Equity|Curncy)$"
    key = F.regexp_extract(text, key_pattern, 1)
    body = F.upper(F.regexp_replace(F.regexp_replace(text, key_pattern, ""), r"[\s_-]+", ""))
    pattern = rf"^(.*?)([{MONTH_CODES}])(\d{{1,4}})$"
    root = _group(body, pattern, 1)
    code = _group(body, pattern, 2)
    digits = _group(body, pattern, 3)
    if root_hint is not None:
        hint = F.upper(F.trim(root_hint))
        tail = F.when(body.startswith(hint), F.substring(body, F.length(hint) + 1, F.lit(16)))
        tail_pattern = rf"^([{MONTH_CODES}])(\d{{1,4}})$"
        fits = F.coalesce(tail.rlike(tail_pattern), F.lit(False))
        root = F.when(fits, hint).otherwise(root)
        code = F.when(fits, F.regexp_extract(tail, tail_pattern, 1)).otherwise(code)
        digits = F.when(fits, F.regexp_extract(tail, tail_pattern, 2)).otherwise(digits)
    year = expand_year(digits, reference_year)
    return F.when(
        (root != "") & year.isNotNull(),
        F.struct(
            root.alias("root"), code.alias("month_code"),
            month_name(month_from_code(code)).alias("month"),
            year.alias("year"), key.alias("yellow_key"),
        ),
    )
