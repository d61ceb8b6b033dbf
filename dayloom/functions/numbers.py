"""Parsing and derived measures of numbers as Spark expressions.

Text that is no number gives null instead of failing the job; pair it with
``rejected`` to count such rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def real(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def whole(text: Column) -> Column:
    """Decimal digits with an optional sign, in the range of an int."""
    return whole_long(text).try_cast("int")


def whole_long(text: Column) -> Column:
    """Decimal digits with an optional sign, in the range of a bigint (for keys)."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def is_digits(text: Column) -> Column:
    """1 if the text is digits only (no sign), else 0."""
    return F.coalesce(text.rlike(r"\A[0-9]+\z"), F.lit(False)).cast("int")


def rejected(text: Column, parsed: Column) -> Column:
    return text.isNotNull() & parsed.isNull()


def half_up(number: Column) -> Column:
    """Round to the nearest whole number, halves toward positive infinity."""
    return F.floor(number + F.lit(0.5)).cast("bigint")


def half_up_text(number: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return (half_up(number * scale) / scale).cast("string")


def implied_decimal(text: Column, picture: str) -> Column:
    """Digits without a point; the picture's 9s after the V are decimals (``99V99``)."""
    places = picture.partition("V")[2].count("9")
    return (text.try_cast("decimal(38,18)") / F.lit(10**places).cast("decimal(20,0)")).cast("decimal(38,18)")


def wrap32(number: Column) -> Column:
    """The low 32 bits as a signed int, as 32-bit arithmetic gives them; never fails on larger numbers."""
    low = number.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return (low - F.when(low > INT_MAX, F.lit(2**32)).otherwise(F.lit(0))).cast("int")


def to_hex(number: Column) -> Column:
    """Lower-case hexadecimal, two's complement if negative: of 32 bits within the range of an int, else of 64."""
    wide = number.cast("bigint")
    narrow = wide.between(INT_MIN, INT_MAX)
    return F.lower(F.hex(F.when(narrow, wide.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(wide)))


def from_hex(text: Column) -> Column:
    """Hexadecimal text (optional sign) to int; null beyond the range of an int."""
    return from_hex_long(text).try_cast("int")


def from_hex_long(text: Column) -> Column:
    """Hexadecimal text (optional sign, up to 15 digits) to bigint (for keys); null beyond that."""
    digits = F.ltrim(text, F.lit("+-"))
    size = F.when(text.rlike(r"\A[+-]?[0-9a-fA-F]{1,15}\z"), F.conv(digits, 16, 10).try_cast("bigint"))
    return F.when(text.startswith("-"), -size).otherwise(size)


def digit_char(number: Column) -> Column:
    """The character of a digit 0-9."""
    return F.when(number.between(0, 9), number.cast("int").cast("string"))


def quotient(a: Column, b: Column) -> Column:
    """Whole part of a / b, truncated toward zero and held in the range of an int."""
    ratio = F.try_divide(a, b)
    return F.least(F.greatest(ratio, F.lit(float(INT_MIN))), F.lit(float(INT_MAX))).cast("int")


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; null for a zero divisor."""
    return F.try_mod(a, b)


def compare_text(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by numeric value."""
    return F.when(real(a) > real(b), 1).when(real(a) == real(b), 0).when(
        real(a).isNotNull() & real(b).isNotNull(), -1
    )


def text_arithmetic(a: Column, b: Column, operation: str) -> Column:
    x, y = real(a), real(b)
    return {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": quotient(x, y)}[operation]


# Measures a cleaning rule may ask for, by name.
MEASURES = {
    "abs": F.abs,
    "neg": lambda x: -x,
    "exp": F.exp,
    "ln": F.ln,
    "sqrt": F.sqrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "half_up": half_up,
    "hex": to_hex,
    "bitnot": lambda x: F.bitwise_not(x.cast("bigint")),
}

PAIR_MEASURES = {
    "quotient": quotient,
    "remainder": remainder,
    "bitand": lambda a, b: a.cast("bigint").bitwiseAND(b.cast("bigint")),
    "bitor": lambda a, b: a.cast("bigint").bitwiseOR(b.cast("bigint")),
    "bitxor": lambda a, b: a.cast("bigint").bitwiseXOR(b.cast("bigint")),
}
