"""Rounding and number formatting with exact, stated rules.

``round_product`` multiplies, rounds half-even and divides, which is how array
libraries round. ``round_exact`` rounds the exact binary value of a double,
which is how correctly rounded decimal formatting works. The two differ when the
scaled product happens to land on a tie, so each caller names the one it needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 splits a 53-bit significand into two halves whose products with a
# small power of ten are exact.
_SPLITTER = 134217729.0


def round_product(x: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def round_product_sql(x: str, digits: int) -> str:
    """``round_product`` as SQL text, for expressions built in bulk."""
    return f"(rint(({x}) * 1e{digits}D) / 1e{digits}D)"


def _exact_scaled_integer(x: Column, digits: int) -> Column:
    """Nearest integer to |x|·10^digits, ties to even, from x's exact value."""
    scale = F.lit(float(10**digits))
    a = F.abs(x)
    big = a * F.lit(_SPLITTER)
    high = big - (big - a)
    low = a - high
    floor = F.floor(a * scale).cast("double")
    middle = floor + F.lit(0.5)
    side = (high * scale - middle) + low * scale
    return (
        F.when(side > 0, floor + 1)
        .when(side < 0, floor)
        .when(floor % 2 == 0, floor)
        .otherwise(floor + 1)
    )


def round_exact(x: Column, digits: int) -> Column:
    scaled = _exact_scaled_integer(x, digits) / F.lit(float(10**digits))
    return F.when(x < 0, -scaled).otherwise(scaled)


def fixed_text(x: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, e.g. 0.1235 -> '0.123'."""
    magnitude = _exact_scaled_integer(x, digits) / F.lit(float(10**digits))
    body = F.format_string(f"%.{digits}f", magnitude)
    # A negative number that rounds to zero keeps its sign, as "%.nf" does.
    return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def money_text(amount: Column) -> Column:
    """'$1,234' from a decimal amount, ties to even."""
    return F.concat(F.lit("$"), F.format_number(F.bround(amount, 0), 0))


def clamp_unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def to_number(text: Column) -> Column:
    """Number or NULL; text that is not a number, and NaN, become NULL."""
    return nan_to_null(text.try_cast("double"))
