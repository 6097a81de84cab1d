"""Lenient scalar readers for text fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite_double(text: Column) -> Column:
    """A finite number or null; blanks, words, NaN and infinities are null."""
    n = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def double_or(text: Column, default: float) -> Column:
    return F.coalesce(finite_double(text), F.lit(default))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
