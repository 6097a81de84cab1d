"""Forecast snapshots: extremes per snapshot, drift along a series, payload expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from skytally.functions.scalars import nan_to_null
from skytally.functions.units import plain_number
from skytally.operators.scale import BLOCK, latest_by, running, with_block
from skytally.sources.readers import FORECAST_COLUMN, OBSERVED_COLUMN, pattern_columns

SERIES = ["city", "kind"]
QUARTER = 91 * 86400


def with_extremes(df: DataFrame) -> DataFrame:
    """Row-wise high and low over the pattern-named columns, and the one that matters for the kind."""
    out = df
    for name, pattern in (("forecast", FORECAST_COLUMN), ("observed", OBSERVED_COLUMN)):
        cells = F.array(*[nan_to_null(F.col(c)) for c in pattern_columns(df, pattern)])
        out = out.withColumn(f"{name}_high_calc", F.array_max(cells)).withColumn(f"{name}_low_calc", F.array_min(cells))
        pick = F.when(F.col("kind") == "Highest", F.col(f"{name}_high_calc")).otherwise(F.col(f"{name}_low_calc"))
        out = out.withColumn(f"{name}_extreme", pick)
    return out


def joined_text(df: DataFrame) -> DataFrame:
    """Non-null forecasts of a row as ``a | b | c``; whole numbers without a decimal part."""
    cells = F.filter(F.array(*[nan_to_null(F.col(c)) for c in pattern_columns(df, FORECAST_COLUMN)]), lambda x: x.isNotNull())
    return df.withColumn("forecast_text", F.array_join(F.transform(cells, plain_number), " | "))


def with_drift(df: DataFrame, order: Sequence[str] = ("observed_epoch", "cycle_id", "snap_id")) -> DataFrame:
    """Change from the snapshot before and from the first known value of the series."""
    x = F.col("forecast_extreme")
    cut = with_block(df, "observed_epoch", QUARTER)
    out = running(
        cut, SERIES, [BLOCK], list(order),
        {"_prev": ("last", F.struct(x.alias("x")), True), "_first": ("first", x)},
    )
    out = out.withColumn("drift_from_prev", x - F.col("_prev.x")).withColumn("drift_from_first", x - F.col("_first"))
    return out.drop("_prev", "_first", BLOCK)


def drift_summary(df: DataFrame, order: Sequence[str] = ("observed_epoch", "cycle_id", "snap_id")) -> DataFrame:
    x = F.col("forecast_extreme")
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    return df.groupBy(*SERIES).agg(
        F.count("cycle_id").alias("cycles"),
        F.min_by(x, known("forecast_extreme")).alias("first_forecast"),
        F.max_by(x, known("forecast_extreme")).alias("last_forecast"),
        F.min(x).alias("min_forecast"), F.max(x).alias("max_forecast"),
        F.max_by("drift_from_first", known("drift_from_first")).alias("final_drift_from_first"),
        F.max(F.abs("drift_from_prev")).alias("max_abs_step_drift"),
        F.count("observed_extreme").alias("observed_points"),
    )


def series_chunks(df: DataFrame, size: int = 500, order: Sequence[str] = ("observed_epoch", "cycle_id", "snap_id")) -> DataFrame:
    """Plot points per series as ordered arrays of at most ``size``, numbered within the series."""
    cut = with_block(df, "observed_epoch", QUARTER)
    placed = running(cut, SERIES, [BLOCK], list(order), {"_n": ("count", F.lit(1))})
    points = placed.withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long"))
    point = F.struct("_n", F.col("observed_at").alias("t"), "cycle_id", "forecast_extreme", "forecast_high_calc",
                     "forecast_low_calc", "observed_extreme", "drift_from_prev", "drift_from_first")
    return points.groupBy(*SERIES, "chunk").agg(F.sort_array(F.collect_list(point)).alias("points"))


def unique_snapshots(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First snapshot per key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return latest_by(df, keys, [-F.col(c) for c in order], rest)


def expand_payload(df: DataFrame, arrays: Sequence[str], payload: str = "payload", time: str = "validTimeLocal") -> DataFrame:
    """Parallel arrays of a JSON object to rows, padded to the longest one; broken JSON gives no rows."""
    schema = T.StructType([T.StructField(a, T.ArrayType(T.StringType())) for a in arrays])
    doc = F.from_json(F.col(payload), schema)
    zipped = F.arrays_zip(*[F.coalesce(doc[a], F.array().cast("array<string>")).alias(a) for a in arrays])
    rows = df.select(*[c for c in df.columns if c != payload], F.posexplode(zipped).alias("_i", "_z"))
    return rows.select(
        *[c for c in df.columns if c != payload],
        (F.col("_i") + 1).alias("hour_index"),
        *[F.col("_z").getField(a).alias(a) for a in arrays],
        F.coalesce(F.col("_z").getField(time).startswith(F.col("target_date")), F.lit(False)).alias("is_target_date"),
    )


def target_day(expanded: DataFrame, keys: Sequence[str], value: str = "temperature") -> DataFrame:
    """High, low, count and joined texts of a snapshot's hours on its target day. A snapshot has a bounded
    number of hours, so collecting them is safe."""
    t = F.col(value).try_cast("double")
    hours = expanded.filter("is_target_date").withColumn("_t", t)
    texts = lambda c: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("hour_index", c.alias("v")))), lambda s: s["v"].isNotNull()), lambda s: s["v"])
    return hours.groupBy(*keys).agg(
        F.max("_t").alias("high"), F.min("_t").alias("low"), F.count("_t").alias("hours"),
        F.array_join(texts(plain_number(F.col("_t"))), " | ").alias("temps"),
        F.array_join(texts(F.col("validTimeLocal")), " | ").alias("target_hours"),
    )
