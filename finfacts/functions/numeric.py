"""Number parsing, rounding and number-to-text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from finfacts.reference_data import NON_RATIO_TEXTS

FINITE_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"
# Largest magnitude at which a double still holds every integer.
EXACT_INTEGER = float(2**53)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_number(c: Column | str) -> Column:
    """Whole text must be a finite number (surrounding spaces allowed), else NULL."""
    text = F.trim(_col(c))
    return F.when(text.rlike(FINITE_NUMBER), text.try_cast("double"))


def lenient_number(c: Column | str) -> Column:
    """Like :func:`strict_number` after dropping thousands commas and percent signs."""
    return strict_number(F.regexp_replace(_col(c), "[,%]", ""))


def prefix_number(c: Column | str) -> Column:
    """The number the text starts with (``12abc`` gives 12), else NULL."""
    found = F.regexp_extract(_col(c), LEADING_NUMBER, 1)
    return F.when(found != "", found.try_cast("double"))


def is_ratio(c: Column | str) -> Column:
    """True when a stored text counts as a reported ratio. Never NULL."""
    text = F.trim(_col(c))
    return F.coalesce(~text.isin(NON_RATIO_TEXTS) & text.rlike(FINITE_NUMBER), F.lit(False))


def safe_divide(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / F.nullif(den, F.lit(0.0)))


def round_half_up(c: Column | str, digits: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n``: the same result in any IEEE engine, ties included."""
    x, scale = _col(c), float(10**digits)
    return F.when(F.abs(x) * scale < EXACT_INTEGER, F.floor(x * scale + 0.5) / scale).otherwise(x)


def fixed_text(c: Column | str, digits: int) -> Column:
    """Fixed-point text, ties away from zero. The value is rounded before it becomes a decimal, so no
    engine's float formatting is involved; the expression stays small because callers nest it."""
    x, scale = _col(c), float(10**digits)
    size = F.abs(x)
    # From 2 ** 53 units on a double holds no finer part, and floor would leave the range of a long.
    rounded = F.when(size * scale < EXACT_INTEGER, F.floor(size * scale + 0.5) / scale).otherwise(size)
    return F.concat(
        F.when(x < 0, "-").otherwise(""), rounded.try_cast(f"decimal(38,{digits})").cast("string")
    )


def grouped_text(c: Column | str, max_fraction: int = 3) -> Column:
    """Thousands-grouped text with up to ``max_fraction`` decimals, trailing zeros dropped."""
    x, scale = _col(c), 10**max_fraction
    exact = F.abs(x) * float(scale) < EXACT_INTEGER
    return F.when(exact, _grouped_exact(x, max_fraction)).otherwise(
        F.concat(F.when(x < 0, "-").otherwise(""), F.format_number(F.abs(x).try_cast("decimal(38,0)"), 0))
    )


def _grouped_exact(x: Column, max_fraction: int) -> Column:
    scale = 10**max_fraction
    units = F.floor(F.abs(x) * float(scale) + 0.5)
    sign = F.when((x < 0) & (units > 0), "-").otherwise("")
    whole = F.format_number(((units - units % scale) / scale).cast("bigint"), 0)
    if max_fraction == 0:
        return F.concat(sign, whole)
    fraction = F.rtrim(F.lpad((units % scale).cast("string"), max_fraction, "0"), F.lit("0"))
    return F.concat(sign, whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))


def _magnitude(x: Column) -> tuple[Column, Column]:
    """Divisor and unit letter of an amount, ``(1, "")`` below a million. Scaling first keeps every
    money text a single formatting expression."""
    size = F.abs(x)
    divisor = F.when(size >= 1e12, 1e12).when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).otherwise(1.0)
    unit = F.when(size >= 1e12, "T").when(size >= 1e9, "B").when(size >= 1e6, "M").otherwise("")
    return divisor, unit


def money_text(c: Column | str) -> Column:
    """Dashboard money: T/B/M with two decimals, plain dollars below a million, ``-`` for NULL."""
    x = _col(c)
    divisor, unit = _magnitude(x)
    return F.coalesce(F.concat(F.lit("$"), fixed_text(x / divisor, 2), unit), F.lit("-"))


def money_tool_text(c: Column | str) -> Column:
    """Assistant money: whole grouped dollars (half-even) below a million, ``N/A`` for NULL."""
    x = _col(c)
    divisor, unit = _magnitude(x)
    digits = F.when(F.abs(x) >= 1e6, fixed_text(x / divisor, 2)).otherwise(
        F.format_number(F.rint(x).try_cast("bigint"), 0)
    )
    return F.coalesce(F.concat(F.lit("$"), digits, unit), F.lit("N/A"))


def percent_text(c: Column | str, digits: int = 2) -> Column:
    return F.coalesce(F.concat(fixed_text(c, digits), F.lit("%")), F.lit("-"))


def fraction_percent_text(c: Column | str) -> Column:
    return percent_text(_col(c) * 100.0)


def auto_text(c: Column | str) -> Column:
    """Money from a million up, percent below; NULL stays NULL."""
    x = _col(c)
    divisor, unit = _magnitude(x)
    big = F.abs(x) >= 1e6
    return F.concat(
        F.when(big, "$").otherwise(""), fixed_text(x / divisor, 2), F.when(big, unit).otherwise("%")
    )


def custom_ratio_text(raw: Column, scale: Column, already_percent: Column) -> Column:
    """Display of a user-defined ratio for its ``percent`` / ``dollar`` / raw scale."""
    return (
        F.when(
            scale == "percent",
            F.when(already_percent, percent_text(raw)).otherwise(fraction_percent_text(raw)),
        )
        .when(scale == "dollar", money_text(raw))
        .otherwise(fixed_text(raw, 4))
    )
