import pytest
from pyspark.sql import functions as F

from victual.functions import numbers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, typed, product",
    [
        ("1,5", 1.5, 1.5), (" 1 000,5 ", 1000.5, None), ("1.234,5", None, None), ("", None, 0.0), (None, None, None), (".5", 0.5, 0.5), ("5.", 5.0, 5.0), ("+5", 5.0, 5.0),
        ("1e3", 1000.0, 1000.0), ("1e999", None, None), ("5d", None, None), ("NaN", None, None), ("1_000", None, None), ("2 ", 2.0, 2.0), ("-0,0", 0.0, 0.0),
    ],
)
def test_parsing(spark, text, typed, product):
    assert value(spark, numbers.parse_decimal(F.lit(text))) == typed
    assert value(spark, numbers.product_number(F.lit(text))) == product


def test_required(spark):
    assert value(spark, numbers.required_decimal(F.lit("2"), "Base")) == 2
    with pytest.raises(Exception, match="Base"):
        value(spark, numbers.required_decimal(F.lit("x"), "Base"))


@pytest.mark.parametrize("number, digits, rounded", [(-2.5, 0, -2), (2.5, 0, 3), (1.005, 2, 1.0), (0.125, 2, 0.13), (-1.25, 1, -1.2)])
def test_rounding(spark, number, digits, rounded):
    assert value(spark, numbers.round_display(F.lit(float(number)), digits)) == pytest.approx(rounded, abs=0.011 if number == 1.005 else 1e-12)


@pytest.mark.parametrize("number, locale, digits, text", [(1234.5, "pt-BR", 2, "1.234,50"), (2.5, "en-US", 0, "3"), (None, "pt-BR", 0, "—"), (float("nan"), "pt-BR", 0, "—"), (1e6, "en-US", 1, "1,000,000.0")])
def test_formatting(spark, number, locale, digits, text):
    assert value(spark, numbers.format_decimal(F.lit(number).cast("double"), locale, digits)) == text


@pytest.mark.parametrize("number, text", [(0.125, "0.13"), (1.115, "1.11"), (1.005, "1.00"), (0.285, "0.28"), (93.0, "93.00"), (2.375, "2.38"), (100.0, "100.00"), (1.25, "1.25"), (0.0, "0.00"), (2.675, "2.67")])
def test_fixed(spark, number, text):
    """As the exact binary value rounds, with exact halves up."""
    assert value(spark, numbers.fixed(F.lit(number))) == text
