"""Daily labels, report schedules and series features of weather observations.

Rows carry ``station``, ``tz``, ``seq`` (file order), ``valid_utc`` and ``epoch`` (UTC seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skytally.functions import metar as M
from skytally.functions.timeparse import local_time
from skytally.functions.units import c_to_f
from skytally.operators.scale import BLOCK, CORE, lookback, running

DAY = 86400


def with_local_date(df: DataFrame) -> DataFrame:
    return df.withColumn("local_ts", local_time(F.col("valid_utc"), F.col("tz"))).withColumn(
        "local_date", F.to_date("local_ts")
    )


def daily_highs(reports: DataFrame) -> DataFrame:
    """Highest remark-group temperature per station-local day, automatic reports left out."""
    rows = with_local_date(reports.filter(~M.is_auto(F.col("metar"))))
    rows = rows.withColumn("t", M.tenths_temperature(F.col("metar"))).filter("t IS NOT NULL")
    return rows.groupBy("station", "local_date").agg(F.max("t").alias("high_c"), F.count("*").alias("reports"))


def in_hour_window(local: Column, start_hour: int, end_hour: int) -> Column:
    """From ``start_hour`` on, up to and including ``end_hour``:00:00."""
    h, m, s = F.hour(local), F.minute(local), F.second(local)
    return (h >= start_hour) & ((h < end_hour) | ((h == end_hour) & (m == 0) & (s == 0)))


def label_rows(reports: DataFrame, start_hour: int = 9, end_hour: int = 19, full_day: bool = False) -> DataFrame:
    """In-window rows of labelled days. The label uses the whole day, the output only the window."""
    rows = with_local_date(reports.filter(~M.is_auto(F.col("metar"))))
    if not full_day:
        rows = rows.filter(in_hour_window(F.col("local_ts"), start_hour, end_hour))
    highs = daily_highs(reports).select("station", "local_date", F.round(c_to_f(F.col("high_c")), 1).alias("daily_high_f"))
    return rows.join(highs, ["station", "local_date"])


def modal_minutes(reports: DataFrame, keys=("station", "utc_year"), minute: str = "utc_minute") -> DataFrame:
    """Most frequent report minute per key; a tie goes to the minute seen first."""
    per = reports.groupBy(*keys, minute).agg(F.count("*").alias("n"), F.min(F.struct("epoch", "seq")).alias("first"))
    order = F.struct("n", -F.col("first.epoch"), -F.col("first.seq"))
    return per.groupBy(*keys).agg(F.max_by(minute, order).alias("regular_minute"), F.max("n").alias("regular_count"))


def mark_extra(reports: DataFrame) -> DataFrame:
    """``is_extra``: off the station-year's usual minute, or a correction."""
    rows = reports.withColumn("utc_year", F.year("valid_utc"))
    usual = modal_minutes(rows).select("station", "utc_year", "regular_minute")
    out = rows.join(usual, ["station", "utc_year"], "left")
    extra = F.coalesce(F.col("utc_minute") != F.col("regular_minute"), F.lit(True)) | M.is_correction(F.col("metar"))
    return out.withColumn("is_extra", extra)


def report_schedule(times: DataFrame, hours: int = 24, station: str = "station", utc: str = "valid_utc") -> DataFrame:
    """Regular report minutes, interval and next expected time per station.

    k = clamp(int(reports / hours), 1, 6) most frequent minutes, ties to the smaller minute. At most 60
    minutes exist per station, so the sorted list of minute counts is bounded.
    """
    t = times.select(station, F.date_trunc("minute", utc).alias("t")).distinct()
    per_minute = t.groupBy(station, F.minute("t").alias("minute")).agg(F.count("*").alias("n"), F.max("t").alias("latest"))
    per = per_minute.groupBy(station).agg(
        F.max("latest").alias("latest"),
        F.sum("n").alias("report_count"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "minute"))).alias("ranked"),
    )
    k = F.greatest(F.lit(1), F.least(F.lit(6), F.floor(F.col("report_count") / max(1, hours)))).cast("int")
    per = per.withColumn("minutes", F.sort_array(F.transform(F.slice("ranked", F.lit(1), k), lambda s: s["minute"])))
    interval = F.greatest(F.lit(60), F.floor(F.lit(3600) / F.size("minutes"))).cast("int")
    base = F.unix_seconds(F.date_trunc("hour", "latest"))
    candidates = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda h: F.transform("minutes", lambda m: base + h * 3600 + m * 60))
    )
    upcoming = F.array_min(F.filter(candidates, lambda c: c > F.unix_seconds("latest")))
    return per.select(
        station,
        "latest",
        interval.alias("interval_seconds"),
        "report_count",
        F.array_join("minutes", ",").alias("scheduled_minutes"),
        F.timestamp_seconds(F.coalesce(upcoming, F.unix_seconds("latest") + interval)).alias("expected_next"),
    )


def minute_summary(rows: DataFrame) -> DataFrame:
    """One row per station and minute: everything the bounded look-back frames need, mergeable.

    Copies of a report collapse here in the map-side combine, before any ordered work.
    """
    t, x, seq = F.col("temp_f"), F.col("is_extra"), F.col("seq")
    xt = F.when(x, t)
    some = lambda c: F.when(c.isNotNull(), seq)
    return rows.groupBy("station", "local_date", "epoch").agg(
        F.count(t).alias("n"), F.max(t).alias("hi"), F.min(t).alias("lo"), F.max_by(t, some(t)).alias("last"),
        F.count(xt).alias("xn"), F.max(xt).alias("xhi"), F.min(xt).alias("xlo"), F.max_by(xt, some(xt)).alias("xlast"),
        F.min_by(F.struct(t.alias("t")), seq).alias("head"), F.max_by(F.struct(t.alias("t")), seq).alias("tail"),
    )


def _context(prefix: str, n: str, hi: str, lo: str, last: str, frame) -> list[Column]:
    e = F.col("epoch")
    has = F.col(n) > 0
    top = F.max(F.when(has, F.struct(F.col(hi).alias("v"), (-e).alias("e")))).over(frame)
    low = F.min(F.when(has, F.struct(F.col(lo).alias("v"), e.alias("e")))).over(frame)
    new = F.max(F.when(has, F.struct(e.alias("e"), F.col(last).alias("v")))).over(frame)
    return [
        F.sum(n).over(frame).alias(f"{prefix}_count"),
        top["v"].alias(f"{prefix}_max_temp_f"),
        ((e + top["e"]) / 60.0).alias(f"{prefix}_max_temp_minutes_ago"),
        low["v"].alias(f"{prefix}_min_temp_f"),
        ((e - low["e"]) / 60.0).alias(f"{prefix}_min_temp_minutes_ago"),
        new["v"].alias(f"{prefix}_latest_temp_f"),
        ((e - new["e"]) / 60.0).alias(f"{prefix}_latest_temp_minutes_ago"),
    ]


def lag_columns(steps: dict[str, int], tolerance: int, order: Window) -> list[Column]:
    """Nearest temperature ``step`` seconds back. Only the neighbours on each side count: a null one is
    skipped, not replaced; equal distance goes to the later one."""
    out = []
    e = F.col("epoch")
    for name, step in steps.items():
        after = F.min(F.struct(e.alias("e"), F.col("head.t").alias("t"))).over(order.rangeBetween(-step, -step + tolerance))
        before = F.max(F.struct(e.alias("e"), F.col("tail.t").alias("t"))).over(order.rangeBetween(-step - tolerance, -step - 1))
        d_after = F.when(after["t"].isNotNull(), after["e"] - (e - step))
        d_before = F.when(before["t"].isNotNull(), (e - step) - before["e"])
        use_after = d_after.isNotNull() & (d_before.isNull() | (d_after <= d_before))
        out.append(F.when(use_after, after["t"]).when(d_before.isNotNull(), before["t"]).alias(name))
    return out


def series_features(
    rows: DataFrame,
    context_hours: int = 6,
    lag_hours: int = 6,
    half_hour_lags: int = 0,
    tolerance: int = 1800,
    block: int = 7 * DAY,
    temp: str = "temp_f",
) -> DataFrame:
    """Look-back context, lags and daily context next to each row.

    Rows need station, local_date, epoch, seq, ``temp`` and is_extra, and are read four times: pass a stored
    table or a cheap projection. Frames run over the minute summary in
    (station, week) blocks with an overlap of the longest reach, so no task holds a whole station.
    """
    rows = rows if temp == "temp_f" else rows.withColumn("temp_f", F.col(temp))
    minutes = minute_summary(rows)
    steps = {f"lag_{h}h": h * 3600 for h in range(1, lag_hours + 1)}
    steps |= {f"lag_{m * 30}m": m * 1800 for m in range(1, half_hour_lags + 1, 2)}
    reach = max([context_hours * 3600, *[s + tolerance for s in steps.values()]])
    spread = lookback(minutes, "epoch", reach, block)
    order = Window.partitionBy("station", BLOCK).orderBy("epoch")
    frame = order.rangeBetween(-context_hours * 3600, 0)
    looked = spread.select(
        "station", "epoch", CORE,
        *_context("obs", "n", "hi", "lo", "last", frame),
        *_context("extra", "xn", "xhi", "xlo", "xlast", frame),
        *lag_columns(steps, tolerance, order),
    ).filter(CORE).drop(CORE)
    days = minutes.groupBy("station", "local_date").agg(F.max("hi").alias("h"), F.min("lo").alias("l"))
    previous = days.select(
        "station",
        F.date_add("local_date", 1).alias("local_date"),
        F.col("h").alias("previous_local_day_high_f"),
        F.col("l").alias("previous_local_day_low_f"),
    )
    out = with_day_running(rows).join(looked, ["station", "epoch"]).join(previous, ["station", "local_date"], "left")
    t = F.col("temp_f")
    return out.select(
        "*",
        (F.col("obs_max_temp_f") - F.col("obs_min_temp_f")).alias("obs_temp_range_f"),
        (F.col("extra_count") > 0).cast("int").alias("has_extra"),
        (t - F.col("extra_latest_temp_f")).alias("temp_f_change_from_latest_extra"),
        (t - F.col("extra_max_temp_f")).alias("temp_f_change_from_max_extra"),
        (t - F.col("extra_min_temp_f")).alias("temp_f_change_from_min_extra"),
        *[(t - F.col(n)).alias(n.replace("lag", "change", 1)) for n in steps],
    )


def with_day_running(rows: DataFrame) -> DataFrame:
    """Lowest and highest temperature of the local day up to and including the row, in (time, file) order."""
    cut = rows.withColumn("_run", F.floor(F.col("seq") / 100000).cast("long"))
    out = running(
        cut, ["station", "local_date"], ["epoch", "_run"], ["seq"],
        {"day_min_so_far_f": ("min", F.col("temp_f")), "day_max_so_far_f": ("max", F.col("temp_f"))},
    )
    return out.drop("_run")


def stage_counts(flagged: DataFrame, start_hour: int = 9, end_hour: int = 19) -> DataFrame:
    """One row of counters over the labelling stages, in one pass over flagged lines (``parsed`` column)."""
    rows = with_local_date(flagged)
    ok = F.col("parsed")
    plain = ok & ~M.is_auto(F.col("metar"))
    exact = M.tenths_temperature(F.col("metar")).isNotNull()
    return rows.agg(
        F.count("*").alias("input_lines"),
        F.count_if(ok).alias("parsed_rows"),
        F.count_if(ok & M.is_auto(F.col("metar"))).alias("auto_rows"),
        F.count_if(plain & exact).alias("exact_rows"),
        F.count_if(plain & in_hour_window(F.col("local_ts"), start_hour, end_hour)).alias("window_rows"),
    )
