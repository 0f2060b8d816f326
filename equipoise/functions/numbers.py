"""Exact money arithmetic.

Everything here works on DECIMAL. A value that does not fit a cast raises under ANSI mode;
nothing falls back to DOUBLE.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient_scale(numerator_scale: int) -> int:
    """Scale of an exact quotient: max(s, min(s + 6, 12))."""
    return max(numerator_scale, min(numerator_scale + 6, 12))


def _pow10(n: int) -> Column:
    return F.lit(Decimal(10) ** n)


def _by_padded_scale(num, den, scale, num_type, den_type):
    # The quotient keeps digits(den) + s1 + scale decimals, so its own rounding can never
    # move a value across a tie of the outer ROUND.
    (p1, s1), (p2, s2) = num_type, den_type
    wide = num.cast(f"decimal({p1 + scale},{s1 + scale})")
    return F.round(F.try_divide(wide, den.cast(f"decimal({p2},{s2})")), scale)


def _by_integers(num, den, scale, s1, s2):
    # floor((2|n| + d) / 2d) on integers scaled to whole units.
    integer = "decimal(38,0)"
    d = (F.abs(den) * _pow10(s2)).cast(integer) * _pow10(s1)
    n = (F.abs(num) * _pow10(s1)).cast(integer) * _pow10(scale + s2)
    top, bottom = (n * 2 + d).cast(integer), F.nullif((d * 2).cast(integer), F.lit(0).cast(integer))
    whole = ((top - top % bottom).cast(integer) / bottom).cast(integer)
    # 37 - scale digits times a literal of that scale still fits 38 digits without losing scale.
    signed = F.when((num < 0) != (den < 0), -whole).otherwise(whole).cast(f"decimal({37 - scale},0)")
    return signed * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale or 1},{scale})")


def round_div(
    num: Column,
    den: Column,
    scale: int,
    *,
    num_type: tuple[int, int] = (14, 2),
    den_type: tuple[int, int] = (11, 0),
    div0: bool = False,
) -> Column:
    """``ROUND(num / den, scale)`` half away from zero, exact.

    ``num_type`` and ``den_type`` are the (precision, scale) the operands fit in. A zero
    divisor gives 0 with ``div0`` and NULL without; NULL operands give NULL. When the two
    types leave no room for the padded quotient in 38 digits, integer arithmetic takes over.
    """
    (p1, s1), (p2, s2) = num_type, den_type
    if (p1 - s1) + s2 + (s1 + scale) + p2 + 1 <= 38:
        quotient = _by_padded_scale(num, den, scale, num_type, den_type)
    else:
        quotient = _by_integers(num, den, scale, s1, s2)
    result = quotient.cast(f"decimal(38,{scale})")
    if not div0:
        return F.when(den != 0, result)
    return F.when(den == 0, F.lit(0).cast(f"decimal(38,{scale})")).otherwise(result)


def rounded_ratio(num: Column, den: Column, places: int, *, num_type=(14, 2), den_type=(11, 0), div0=False) -> Column:
    """Two-step rounding: the quotient at its own scale first, then the outer ROUND."""
    inner = round_div(num, den, quotient_scale(num_type[1]), num_type=num_type, den_type=den_type, div0=div0)
    return F.round(inner, places)


def exact_avg(value: Column, places: int, *, value_type=(14, 2)) -> Column:
    """Aggregate: ``ROUND(AVG(value), places)`` from the exact sum and count."""
    p, s = value_type
    return rounded_ratio(F.sum(value.cast(f"decimal({p},{s})")), F.count(value), places, num_type=(p, s))


def line_amount(quantity: Column, price: Column, discount_pct: Column) -> Column:
    """Discounted line value, rounded to the cent once, half away from zero."""
    factor = F.lit(1) - discount_pct.cast("decimal(5,2)") * F.lit(Decimal("0.01"))
    return F.round(gross_amount(quantity, price) * factor, 2)


def gross_amount(quantity: Column, price: Column) -> Column:
    return quantity.cast("decimal(18,0)") * price.cast("decimal(10,2)")


def cents_to_units(cents: Column, precision: int = 12) -> Column:
    """Division by the constant 100, as an exact multiplication."""
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(f"decimal({precision},2)")


def to_integer(value: Column) -> Column:
    """DECIMAL to a whole number, half away from zero (a bare cast truncates)."""
    return F.round(value, 0).cast("decimal(38,0)")


def try_to_number(text: Column, precision: int = 38, scale: int = 0) -> Column:
    """Blank, formatted or unparseable text gives NULL; extra decimals round half away."""
    return text.try_cast(f"decimal({precision},{scale})")


def try_to_double(text: Column) -> Column:
    return text.try_cast("double")


def round_half_even(value: Column, scale: int) -> Column:
    """Ties go to the even neighbour, unlike ROUND, which takes them away from zero."""
    return F.bround(value, scale)


def divide_or_raise(num: Column, den: Column) -> Column:
    """Plain division: a zero divisor fails the query, whatever the session's ANSI setting."""
    return F.when(den == 0, F.raise_error(F.lit("division by zero"))).otherwise(num / den)
