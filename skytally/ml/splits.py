"""Temporal splits and feature sets.

Years in the data are a bounded list (tens), so they are read once on the driver; rows are only tagged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

TARGET = "daily_high_f"
NEVER_FEATURES = {TARGET, "station", "valid", "metar", "local_year", "valid_utc_epoch"}
WEEKLY_NEVER = NEVER_FEATURES | {"local_iso_year", "local_day_of_week", "local_iso_day_of_week"}
# Columns each calendar variant leaves out.
VARIANT_DROPS = {
    "month_day": {"local_day_of_year", "local_doy_sin", "local_doy_cos", "local_week_of_year"},
    "week_of_year": {"local_month", "local_day", "local_day_of_year", "local_doy_sin", "local_doy_cos"},
    "cyclical_day_of_year": {"local_month", "local_day", "local_day_of_year", "local_week_of_year"},
}


def feature_columns(columns: Sequence[str], variant: str, weekly: bool = False) -> list[str]:
    drop = (WEEKLY_NEVER if weekly else NEVER_FEATURES) | VARIANT_DROPS[variant]
    return [c for c in columns if c not in drop]


def years_of(df: DataFrame, year: str = "local_year") -> list[int]:
    return sorted(int(r[0]) for r in df.select(year).filter(F.col(year).isNotNull()).distinct().collect())


def recent_years(df: DataFrame, fraction: float = 0.2, year: str = "local_year", years: list[int] | None = None) -> DataFrame:
    """``split``: the latest ceil(n * fraction) years validate, earlier ones train. Five years are needed."""
    years = years_of(df, year) if years is None else years
    if len(years) < 5:
        raise ValueError(f"not enough years for a time split: {years}")
    cutoff = years[-max(1, math.ceil(len(years) * fraction))]
    return df.withColumn("split", F.when(F.col(year) >= cutoff, "validation").when(F.col(year) < cutoff, "train"))


def year_blocks(years: Sequence[int], anchor: int, train: int, single: bool = False) -> list[tuple[int, list[int]]]:
    """(validation year, train years) stepping back by train + 1; a block needs all of its years."""
    have = set(years)
    blocks = [
        (v, list(range(v - train, v)))
        for v in range(anchor, min(years) - 1, -(train + 1))
        if v in have and have.issuperset(range(v - train, v))
    ]
    if not blocks:
        raise ValueError("no year block fits the data")
    return blocks[:1] if single else blocks


def rolling_blocks(df: DataFrame, anchor: int, train: int, single: bool = False, year: str = "local_year", years: list[int] | None = None) -> DataFrame:
    """``split``, with ``block`` naming the validation year; rows outside every block have neither."""
    blocks = year_blocks(years_of(df, year) if years is None else years, anchor, train, single)
    split, block = F.lit(None).cast("string"), F.lit(None).cast("int")
    for v, ts in blocks:
        split = F.when(F.col(year) == v, "validation").when(F.col(year).isin(ts), "train").otherwise(split)
        block = F.when(F.col(year).isin([v, *ts]), v).otherwise(block)
    return df.withColumn("split", split).withColumn("block", block)


def weekly_holdout(df: DataFrame, iso_day: int, column: str = "local_iso_day_of_week") -> DataFrame:
    if not 1 <= iso_day <= 7:
        raise ValueError("ISO weekday must be 1..7")
    return df.withColumn("split", F.when(F.col(column) == iso_day, "validation").otherwise("train"))
