"""Prediction error reports, rankings, schedule slots and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skytally.operators.observations import modal_minutes
from skytally.operators.scale import exact_percentiles, null_safe_join, running, top_rows


def _pct(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100.0


def error_report(
    df: DataFrame,
    keys: Sequence[str],
    error: str = "error_f",
    unit: str = "f",
    within: Sequence[float] = (1, 2, 3),
    beyond: float | None = 3.0,
    probs: dict[str, float] | None = None,
    actual: str | None = None,
    predicted: str | None = None,
    bin_width: float = 0.05,
    approximate: bool = False,
) -> DataFrame:
    """Error measures per group. Percentiles are exact and distributed; ``approximate`` opts out."""
    e = F.col(error)
    a = F.abs(e)
    label = lambda x: f"{x:g}".replace(".", "_")
    probs = {f"median_abs_error_{unit}": 0.5, f"p75_abs_error_{unit}": 0.75, f"p90_abs_error_{unit}": 0.9,
             f"p95_abs_error_{unit}": 0.95} if probs is None else probs
    aggs = [
        F.count("*").alias("count"), F.avg(e).alias(f"bias_mean_{unit}"), F.avg(a).alias(f"mae_{unit}"),
        F.sqrt(F.avg(e * e)).alias(f"rmse_{unit}"),
    ]
    if actual:
        aggs.append(F.avg(actual).alias(f"actual_mean_{unit}"))
    if predicted:
        aggs.append(F.avg(predicted).alias(f"prediction_mean_{unit}"))
    aggs += [_pct(a <= w).alias(f"within_{label(w)}{unit}_pct") for w in within]
    if beyond is not None:
        aggs += [_pct(e < -beyond).alias(f"under_by_more_than_{label(beyond)}{unit}_pct"),
                 _pct(e > beyond).alias(f"over_by_more_than_{label(beyond)}{unit}_pct")]
    if approximate:
        aggs += [F.percentile_approx(a, p, 10000).alias(n) for n, p in probs.items()]
    base = df.groupBy(*keys).agg(*aggs)
    if approximate or not probs:
        return base
    shares = exact_percentiles(df.select(*keys, a.alias("_a")), keys, "_a", probs, bin_width)
    return null_safe_join(base, shares, list(keys), "left")


SHORT_PROBS = {"median_abs_error_f": 0.5, "p90_abs_error_f": 0.9}


def short_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return error_report(df, keys, beyond=None, probs=SHORT_PROBS)


def celsius_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return error_report(df, keys, "error_c", "c", within=(0.5, 1, 1.5, 2), beyond=None)


def fit_measures(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 = 1 - SSE/SST from one pass."""
    y, p = F.col(actual), F.col(predicted)
    sse, sst = F.sum((p - y) * (p - y)), F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), F.avg(F.abs(p - y)).alias("mae"),
        (1.0 - F.try_divide(sse, sst)).alias("r2"),
    )


def rank_stations(by_station: DataFrame, by_station_hour: DataFrame) -> DataFrame:
    """Station ranking by MAE with each station's best and worst hour. Inputs are aggregates: one row per
    station, and at most 24 per station."""
    pick = lambda row, p: [F.col(f"{row}.local_hour").alias(f"{p}_local_hour_by_mae"), F.col(f"{row}.mae_f").alias(f"{p}_local_hour_mae_f"),
                           F.col(f"{row}.rmse_f").alias(f"{p}_local_hour_rmse_f"), F.col(f"{row}.within_2f_pct").alias(f"{p}_local_hour_within_2f_pct")]
    row = F.struct("local_hour", "mae_f", "rmse_f", "within_2f_pct")
    hours = by_station_hour.groupBy("station").agg(
        F.min_by(row, F.struct("mae_f", "rmse_f", "local_hour")).alias("best"),
        F.max_by(row, F.struct("mae_f", "rmse_f", -F.col("local_hour"))).alias("worst"),
    )
    out = by_station.join(hours, "station", "left").select(by_station["*"], *pick("best", "best"), *pick("worst", "worst"))
    # The rank is a running count over bands of the error, so the stations never meet in one task.
    banded = out.withColumn("_band", F.coalesce(F.floor(F.col("mae_f") * 100).cast("long"), F.lit(2**40)))
    ranked = running(banded, [], ["_band"], ["mae_f", "rmse_f", "station"], {"rank_by_mae": ("count", F.lit(1))})
    return ranked.drop("_band")


def compare_with_baseline(report: DataFrame, baseline: DataFrame, key: str = "local_hour") -> DataFrame:
    """Left join with a baseline report; deltas are null where the baseline has no such group."""
    base = baseline.select(key, *[F.col(c).alias(f"baseline_{c}") for c in baseline.columns if c != key])
    out = report.join(base, key, "left")
    deltas = {"rmse_f": "rmse", "mae_f": "mae", "median_abs_error_f": "median_abs_error"}
    return out.select("*", *[(F.col(c) - F.col(f"baseline_{c}")).alias(f"{n}_delta_specialized_minus_baseline") for c, n in deltas.items()])


def snap_to_schedule(df: DataFrame, hour: str = "local_hour", minute: str = "local_minute") -> DataFrame:
    """Nearest regular slot: the station's usual local minute and the one 30 minutes later, around midnight
    too. Equal distance goes to the earlier slot. Only the four slots next to the row can win."""
    usual = modal_minutes(df, ("station",), minute).select("station", "regular_minute")
    out = df.join(usual, "station")
    now = F.col(hour) * 60 + F.col(minute)
    first = F.col("regular_minute") % 30
    # Slots are every 30 minutes from `first`; the candidates around `now` are k and k + 1.
    k = F.floor((now - first) / 30.0).cast("int")
    slot = lambda n: F.pmod(first + n * 30, F.lit(1440)).cast("int")
    gap = lambda t: F.least(F.abs(t - now), 1440 - F.abs(t - now))
    best = F.array_min(F.array(*[F.struct(gap(slot(k + n)).alias("d"), slot(k + n).alias("t")) for n in (-1, 0, 1, 2)]))
    out = out.withColumn("_t", best["t"])
    return out.withColumn("scheduled_local_hour", F.floor(F.col("_t") / 60).cast("int")).withColumn(
        "scheduled_local_minute", (F.col("_t") % 60).cast("int")
    ).drop("_t", "regular_minute")


def reliable(report: DataFrame, samples: int = 100, mae: float = 0.6, within: float = 90.0) -> DataFrame:
    return report.filter((F.col("count") >= samples) & (F.col("mae_c") <= mae) & (F.col("within_1c_pct") >= within))


def recommendations(slots: DataFrame, samples: int = 100, best: int = 5) -> DataFrame:
    """Per station the best supported slots by error, and the earliest reliable one (``pick``)."""
    supported = slots.filter(F.col("count") >= samples)
    time = [F.col("local_hour"), F.col("local_minute")]
    top = top_rows(supported, ["station"], [F.col("mae_c"), F.col("rmse_c"), *time], best, "rank").withColumn("pick", F.lit("best"))
    early = top_rows(reliable(slots, samples), ["station"], time, 1, "rank").withColumn("pick", F.lit("earliest_reliable"))
    return top.unionByName(early)


def calibration(df: DataFrame, bin_width: float = 0.05) -> DataFrame:
    """Residuals by (station, month, hour); error = predicted - actual. The robust sigma is 1.4826 times the
    median absolute deviation from the median, our choice."""
    keys = ["station", "month", "local_hour"]
    e = F.col("error_f")
    base = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg(e).alias("error_mean_f"), F.stddev_samp(e).alias("error_std_f"),
        F.avg(F.abs(e)).alias("mae_f"), _pct(F.abs(e) <= 1).alias("within_1f_pct"), _pct(F.abs(e) <= 2).alias("within_2f_pct"),
    )
    # Both medians of the errors come from one pass over stacked values.
    stacked = df.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("w"), e.alias("x")), F.struct(F.lit(1).alias("w"), F.abs(e).alias("x")))).alias("s"))
    medians = exact_percentiles(stacked.select(*keys, "s.w", "s.x"), [*keys, "w"], "x", {"p": 0.5}, bin_width)
    middle = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("w") == 0, F.col("p"))).alias("error_median_f"), F.max(F.when(F.col("w") == 1, F.col("p"))).alias("median_abs_error_f"))
    around = null_safe_join(df, middle, keys).select(*keys, F.abs(e - F.col("error_median_f")).alias("_d"))
    spread = exact_percentiles(around, keys, "_d", {"_mad": 0.5}, bin_width)
    out = null_safe_join(null_safe_join(base, middle, keys), spread, keys)
    return out.withColumn("error_robust_sigma_f", F.col("_mad") * 1.4826).drop("_mad")
