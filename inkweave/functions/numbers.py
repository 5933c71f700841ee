"""Numbers to text and back, as columns.

Four significant digits and shortest float text follow C's rounding, which the
JVM's formatter doesn't (it rounds halves up), so those two are Arrow UDFs over
whole columns; the rest are built-in expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def safe_int(text: Column) -> Column:
    """Integer of a well-formed text, else null (never 0)."""
    return F.when(text.rlike(_INT), F.regexp_replace(text, r"^\s*\+?|\s+$", "").try_cast("int"))


def safe_float(text: Column) -> Column:
    """Double of a well-formed finite number, else null."""
    value = F.regexp_replace(text, r"^\s+|\s+$", "").try_cast("double")
    return F.when(text.rlike(_FLOAT) & (F.abs(value) < float("inf")), value)


def rounded(value: Column) -> Column:
    """The nearest whole number, halves away from zero; the sign stays, so that -0.3 gives -0.0 as in C."""
    return F.signum(value) * F.round(F.abs(value))


@pandas_udf(StringType())
def four_digits(v: pd.Series) -> pd.Series:
    """At most four significant digits, the shortest of fixed and exponent form; null stays null."""
    return v.map(lambda x: f"{x:.4g}", na_action="ignore").astype(object)


@pandas_udf(ArrayType(ArrayType(StringType())))
def four_digits_nested(v: pd.Series) -> pd.Series:
    """``four_digits`` for the values of all series of a chart."""
    return v.map(lambda rows: None if rows is None else [None if r is None else [None if x is None or x != x else f"{x:.4g}" for x in r] for r in rows])


@pandas_udf(StringType())
def plain_number(v: pd.Series) -> pd.Series:
    """Whole numbers without a fraction, others in shortest form; null is empty."""
    return v.map(lambda x: "" if x is None or x != x else str(int(x)) if x == int(x) else repr(float(x)))


@pandas_udf(ArrayType(StringType()))
def plain_numbers(v: pd.Series) -> pd.Series:
    return v.map(lambda r: None if r is None else ["" if x is None or x != x else str(int(x)) if x == int(x) else repr(float(x)) for x in r])


def decimals(code: Column) -> Column:
    """Digits after the point that a number format asks for."""
    after = F.regexp_extract(code, r"^[^.]*\.([^;\s]*)", 1)
    return F.length(F.regexp_replace(after, "[^0#]", ""))


def fixed(value: Column, digits: Column) -> Column:
    """Thousands-separated text with a fixed number of decimals."""
    return F.call_function("format_number", value, digits.cast("int"))


def style(code: Column) -> Column:
    """What a number format asks for, so that it is read once for many values: ``percent``, ``shown`` (it has digits) and ``digits``."""
    percent = F.instr(code, "%") > 0
    digits = F.when(percent, decimals(F.regexp_extract(code, r"^([^%]*)", 1))).otherwise(decimals(code))
    return F.struct(percent.alias("percent"), code.rlike("[0#]").alias("shown"), digits.alias("digits"))


def formatted(value: Column, how: Column, four: Column) -> Column:
    """A value in the style of its number format; ``four`` is its four-digit text, used where the format has no digits."""
    percent = F.concat(F.replace(fixed(value * 100, how["digits"]), F.lit(","), F.lit("")), F.lit("%"))
    shown = F.when(how["percent"], percent).when(how["shown"], fixed(value, how["digits"])).otherwise(four)
    return F.when(value.isNull(), "").otherwise(shown)
