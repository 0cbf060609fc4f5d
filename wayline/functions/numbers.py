"""Number rules: safe parsing, rounding and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline import fixed_values as V


def finite(x: Column) -> Column:
    """Double, with NaN and the infinities as null; NaN is above infinity in comparisons."""
    d = x.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def number_of(text: Column) -> Column:
    """Double from text, NaN and the infinities included; blank and unparseable text is null."""
    return F.trim(text.cast("string")).try_cast("double")


def safe_number(text: Column) -> Column:
    """Finite double from text; blank and unparseable text is null."""
    return finite(number_of(text))


def clean_number(text: Column) -> Column:
    return F.round(safe_number(text), 1)


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def fixed_text(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.format_string(f"%.{digits}f", F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale))


def plain_text(x: Column) -> Column:
    """Number text without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def mps_to_mph(x: Column) -> Column:
    return x * F.lit(V.MPS_TO_MPH)


def knots_to_mph(x: Column) -> Column:
    return x * F.lit(V.KNOTS_TO_MPH)


def meters_to_miles(x: Column) -> Column:
    return x / F.lit(V.METERS_PER_MILE)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
