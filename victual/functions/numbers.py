"""Parsing, rounding and formatting numbers: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a decimal may look like once blanks are gone and a comma is a dot.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EPSILON = 2.220446049250313e-16
MISSING = "—"


def _decimal(text: Column) -> Column:
    """The text is named once, so that long expressions in its place are computed once."""
    number = F.regexp_extract(F.regexp_replace(text, "^([^,]*),", "$1."), DECIMAL, 0).try_cast("double")
    return F.get(F.filter(F.array(number), lambda x: F.abs(x) < F.lit(float("inf"))), F.lit(0))


def parse_decimal(text: Column) -> Column:
    """A typed decimal: blanks are ignored, the first comma is the decimal sign, else null."""
    return _decimal(F.regexp_replace(text, r"(?U)\s+", ""))


def required_decimal(text: Column, field: str) -> Column:
    """As ``parse_decimal``, but an error that names the field instead of null."""
    value = parse_decimal(text)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{field}: not a number")).cast("double"))


def product_number(text: Column) -> Column:
    """A number of product data: as a typed one, but blank is 0 and blanks within aren't ignored."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0.0)).otherwise(_decimal(trimmed))


def round_display(value: Column, digits: int = 2) -> Column:
    """Half goes towards positive infinity."""
    scale = float(10**digits)
    return F.floor((value + F.lit(EPSILON)) * scale + 0.5) / scale


def fixed(value: Column, digits: int = 2) -> Column:
    """The digits of the exact binary value, halves up, ungrouped; of values that aren't negative."""
    # Only odd multiples of 1/8 lie halfway between hundredths; the formatter would round them to even.
    half = (value * 8) % 2 == 1 if digits == 2 else F.lit(False)
    return F.replace(F.format_number(F.when(half, value + 0.001).otherwise(value), digits), F.lit(","), F.lit(""))


def format_decimal(value: Column, locale: str = "pt-BR", digits: int = 0) -> Column:
    """Fixed digits and grouped thousands; a dash for null and NaN."""
    text = F.format_number(F.round(value, digits), digits)
    if locale == "pt-BR":
        text = F.translate(text, ",.", ".,")
    return F.when(value.isNull() | F.isnan(value), F.lit(MISSING)).otherwise(text)


def ratio_percent(value: Column, target: Column) -> Column:
    return F.try_divide(value, target) * 100


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))
