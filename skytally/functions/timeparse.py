"""Times: local calendar columns, flexible UTC parsing, year inference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def local_time(utc: Column, tz: Column) -> Column:
    return F.from_utc_timestamp(utc, tz)


def with_local_calendar(df: DataFrame, utc: str = "valid_utc", tz: str = "tz") -> DataFrame:
    df = df.withColumn("local_ts", local_time(F.col(utc), F.col(tz)))
    t = F.col("local_ts")
    minute = F.hour(t) * 60 + F.minute(t)
    day_angle = 2.0 * math.pi * minute / 1440.0
    year_angle = 2.0 * math.pi * F.dayofyear(t) / 366.0
    return df.select(
        "*",
        F.to_date(t).alias("local_date"),
        F.year(t).alias("local_year"),
        F.month(t).alias("local_month"),
        F.dayofmonth(t).alias("local_day"),
        F.dayofyear(t).alias("local_day_of_year"),
        F.weekday(t).alias("local_day_of_week"),
        F.hour(t).alias("local_hour"),
        F.minute(t).alias("local_minute"),
        minute.alias("local_minutes_since_midnight"),
        F.sin(day_angle).alias("local_hour_sin"),
        F.cos(day_angle).alias("local_hour_cos"),
        F.sin(year_angle).alias("local_doy_sin"),
        F.cos(year_angle).alias("local_doy_cos"),
    )


def with_iso_calendar(df: DataFrame, year: str = "local_year", month: str = "local_month", day: str = "local_day") -> DataFrame:
    """ISO week, ISO year and ISO weekday of a possibly invalid date."""
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in (year, month, day)])
    d = F.try_to_date(text, "y-M-d")
    return df.select(
        "*",
        F.weekofyear(d).alias("iso_week"),
        F.extract(F.lit("yearofweek"), d).cast("int").alias("iso_year"),
        F.extract(F.lit("dayofweek_iso"), d).cast("int").alias("iso_weekday"),
    )


def flexible_utc(text: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e10) or ISO text; ISO without a zone is UTC."""
    number = text.try_cast("double")
    seconds = F.when(number > 1e10, number / 1000.0).otherwise(number)
    from_number = F.timestamp_micros(F.round(seconds * 1e6).cast("long"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.when(number.isNotNull(), from_number).otherwise(iso)


def first_utc(*fields: Column) -> Column:
    """Time from the first field that is neither null, blank nor zero."""
    present = [F.when(~F.coalesce(f.cast("string"), F.lit("")).isin("", "0", "0.0"), f.cast("string")) for f in fields]
    return flexible_utc(F.coalesce(*present))


def infer_year_date(month_day: Column, today: Column) -> Column:
    """``June 8`` to a date: this year, or the next one when that lies over 180 days back."""
    this_year = F.try_to_date(F.concat_ws(" ", month_day, F.year(today).cast("string")), "MMMM d y")
    next_year = F.try_to_date(F.concat_ws(" ", month_day, (F.year(today) + 1).cast("string")), "MMMM d y")
    return F.when(F.datediff(today, this_year) > 180, next_year).otherwise(this_year)


def report_time(text: Column, pattern: str = "y-M-d H:m") -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit(pattern))
