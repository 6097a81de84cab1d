"""Temperature units, rounding policies and comparable interval bounds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def c_to_f(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def f_to_c(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def convert(value: Column, source: Column, target: Column) -> Column:
    """C<->F; any other pair of units passes the value through. Null stays null."""
    src, dst = F.upper(source), F.upper(target)
    return (
        F.when((src == "C") & (dst == "F"), c_to_f(value))
        .when((src == "F") & (dst == "C"), f_to_c(value))
        .otherwise(value)
    )


def half_up(x: Column) -> Column:
    """Whole degrees, .5 always upwards (also below zero)."""
    return F.floor(x + 0.5).cast("long")


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def live_whole_f(temp_c: Column) -> Column:
    """The live feed's path: C to F to C and back before half-even rounding."""
    return half_even(c_to_f(f_to_c(c_to_f(temp_c))))


def tidy(x: Column, places: int = 6) -> Column:
    """Report rounding; adding zero turns -0.0 into 0.0."""
    return F.round(x.cast("double"), places) + F.lit(0.0)


def comparable_bounds(lo: Column, hi: Column, unit: Column, target: Column) -> tuple[Column, Column]:
    return convert(lo, unit, target), convert(hi, unit, target)


def rounding_bounds_f(lo: Column, hi: Column, unit: Column) -> tuple[Column, Column]:
    """Continuous Fahrenheit range whose rounding lands in the interval; open ends are infinite."""
    f = F.lit("F")
    return (
        F.coalesce(convert(lo, unit, f) - 0.5, F.lit(float("-inf"))),
        F.coalesce(convert(hi, unit, f) + 0.5, F.lit(float("inf"))),
    )


def contains(value: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (value >= lo)) & (hi.isNull() | (value <= hi))


def plain_number(x: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def interval_label(lo: Column, hi: Column, unit: Column, market_id: Column) -> Column:
    return (
        F.when(lo.isNull() & hi.isNull(), market_id.cast("string"))
        .when(lo.isNull(), F.concat(F.lit("<="), plain_number(hi), unit))
        .when(hi.isNull(), F.concat(F.lit(">="), plain_number(lo), unit))
        .otherwise(F.concat(plain_number(lo), F.lit("-"), plain_number(hi), unit))
    )


def midpoint_f(lo: Column, hi: Column, unit: Column) -> Column:
    f = F.lit("F")
    return (convert(lo, unit, f) + convert(hi, unit, f)) / 2.0
