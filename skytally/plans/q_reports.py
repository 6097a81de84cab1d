"""Feed comparison, error reports, forecast drift."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.functions.units import tidy
from skytally.operators import compare as C
from skytally.operators import drift as D
from skytally.operators import evaluate as E
from skytally.operators.observations import with_local_date
from skytally.operators.scale import top_rows
from skytally.plans.q_observations import SQL_LOCAL
from skytally.plans.registry import query, r

# Two feeds -------------------------------------------------------------------------------------------------
SQL_PTS = (
    ", pa AS (SELECT station, epoch, tz, arg_max(temp_f, seq) AS f FROM feed_a GROUP BY 1, 2, 3), pb AS (SELECT station, epoch, tz, arg_max(temp_f, seq) AS f FROM feed_b GROUP BY 1, 2, 3)"
)
SQL_BOTH = SQL_PTS + (
    ", bo AS (SELECT coalesce(pa.station, pb.station) AS station, coalesce(pa.epoch, pb.epoch) AS epoch, pa.f AS a, pb.f AS b,"
    " CAST(((make_timestamp(coalesce(pa.epoch, pb.epoch) * 1000000) AT TIME ZONE 'UTC') AT TIME ZONE coalesce(pa.tz, pb.tz)) AS DATE) AS d"
    " FROM pa FULL JOIN pb ON pa.station = pb.station AND pa.epoch = pb.epoch)"
)


@query("set3_last_wins", "feed_b", "SELECT station, epoch, arg_max(temp_f, seq) AS temp_f FROM feed_b GROUP BY 1, 2")
def set3(v):
    return C.last_per_minute(v.feed_b).select("station", "epoch", "temp_f")


@query("set2_distinct_points", "feed_b", "SELECT DISTINCT station, epoch, temp_f FROM feed_b")
def set2(v):
    return v.feed_b.select("station", "epoch", "temp_f").distinct()


@query(
    "set1_minute_sets", "feed_a feed_b",
    ", a AS (SELECT DISTINCT station, epoch FROM feed_a), b AS (SELECT DISTINCT station, epoch FROM feed_b) SELECT *, 'both' AS membership FROM (SELECT * FROM a INTERSECT SELECT * FROM b)"
    " UNION ALL SELECT *, 'a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
)
def set1(v):
    return C.minute_sets(v.feed_a, v.feed_b)


@query("joi5_matched_points", "feed_a feed_b", SQL_PTS + " SELECT pa.station, pa.epoch, pa.f AS a_f, pb.f AS b_f FROM pa JOIN pb ON pa.station = pb.station AND pa.epoch = pb.epoch WHERE pa.f <> pb.f")
def joi5(v):
    return C.matched(v.feed_a, v.feed_b).filter("a_f <> b_f")


@query(
    "joi6_one_sided_points", "feed_a feed_b",
    SQL_PTS + " SELECT 'a' AS side, station, epoch, f AS temp_f FROM pa WHERE NOT EXISTS (SELECT 1 FROM pb WHERE pb.station = pa.station AND pb.epoch = pa.epoch)"
    " UNION ALL SELECT 'b', station, epoch, f FROM pb WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pb.station = pa.station AND pb.epoch = pa.epoch)",
)
def joi6(v):
    one = lambda x, y, n: C.only_in_first(x, y).select(F.lit(n).alias("side"), "station", "epoch", "temp_f")
    return one(v.feed_a, v.feed_b, "a").unionByName(one(v.feed_b, v.feed_a, "b"))


@query("agg2_daily_feed", "feed_a", f", p AS (SELECT station, tz, epoch, valid_utc, arg_max(temp_f, seq) AS f FROM feed_a GROUP BY 1, 2, 3, 4) SELECT station, CAST({SQL_LOCAL} AS DATE) AS local_date, count(*) AS count, max(f) AS high, min(f) AS low FROM p GROUP BY 1, 2")
def agg2(v):
    return C.daily_feed(v.feed_a)


SQL_DAYS = SQL_BOTH + (
    ", dd AS (SELECT station, d AS local_date, count(a) AS a_count, count(b) AS b_count, count_if(a IS NOT NULL AND b IS NOT NULL) AS common_count, max(a) AS a_high, max(b) AS b_high, min(a) AS a_low, min(b) AS b_low,"
    " max(a) FILTER (WHERE b IS NOT NULL) AS common_a_high, max(b) FILTER (WHERE a IS NOT NULL) AS common_b_high, min(a) FILTER (WHERE b IS NOT NULL) AS common_a_low, min(b) FILTER (WHERE a IS NOT NULL) AS common_b_low FROM bo GROUP BY 1, 2),"
    " de AS (SELECT *, b_high - a_high AS high_diff, b_low - a_low AS low_diff, common_b_high - common_a_high AS common_high_diff, common_b_low - common_a_low AS common_low_diff FROM dd)"
)


@query("joi7_daily_comparison", "feed_a feed_b", SQL_DAYS + " SELECT * FROM de")
def joi7(v):
    return C.daily_comparison(C.side_by_side(v.feed_a, v.feed_b))


@query(
    "agg12_comparison_rollup", "feed_a feed_b",
    SQL_DAYS + " SELECT station, count(*) AS daily_rows, CAST(sum(a_count) AS BIGINT) AS a_points, CAST(sum(b_count) AS BIGINT) AS b_points, CAST(sum(common_count) AS BIGINT) AS common_points, "
    + ", ".join(f"count_if({c}_diff IS NOT NULL AND {c}_diff <> 0) AS {c}_mismatches" for c in ("high", "low", "common_high", "common_low"))
    + ", max(abs(high_diff)) AS max_abs_high_diff, max(abs(low_diff)) AS max_abs_low_diff FROM de GROUP BY ROLLUP (station)",
)
def agg12(v):
    return C.rollup_days(C.daily_comparison(C.side_by_side(v.feed_a, v.feed_b)))


@query(
    "agg11_point_summary", "feed_a feed_b",
    SQL_BOTH + " SELECT station, d AS local_date, count(a) AS a_count, count(b) AS b_count, count_if(a IS NOT NULL AND b IS NOT NULL) AS common_count, count(*) FILTER (WHERE a <> b) AS mismatch_count,"
    " count_if(b IS NULL) AS only_a_count, count_if(a IS NULL) AS only_b_count, min(a) AS a_min, max(a) AS a_max, min(b) AS b_min, max(b) AS b_max,"
    " array_to_string(list(concat(epoch, ':', a, ':', b) ORDER BY epoch) FILTER (WHERE a <> b)[1:5], ',') AS sample_mismatches,"
    " count(*) FILTER (WHERE a <> b) + count_if(b IS NULL) + count_if(a IS NULL) = 0 AS exact_match, min(b) - min(a) AS low_diff, max(b) - max(a) AS high_diff FROM bo GROUP BY 1, 2",
)
def agg11(v):
    return C.point_summary(C.side_by_side(v.feed_a, v.feed_b))


@query(
    "agg26_station_ratios", "feed_a feed_b",
    SQL_BOTH + f" SELECT station, count_if(a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE a <> b) AS mismatched, count_if(b IS NULL) AS only_a, count_if(a IS NULL) AS only_b, count(*) AS points,"
    f" {r('count(*) FILTER (WHERE a <> b) / nullif(count_if(a IS NOT NULL AND b IS NOT NULL), 0)')} AS mismatch_ratio, {r('(count_if(b IS NULL) + count_if(a IS NULL)) / count(*)')} AS one_sided_ratio FROM bo GROUP BY 1",
)
def agg26(v):
    df = C.station_ratios(C.side_by_side(v.feed_a, v.feed_b))
    return df.withColumns({c: tidy(F.col(c)) for c in ("mismatch_ratio", "one_sided_ratio")})


@query("srt6_first_mismatches", "feed_a feed_b", SQL_PTS + " SELECT pa.station, pa.epoch, pa.f AS a_f, pb.f AS b_f FROM pa JOIN pb ON pa.station = pb.station AND pa.epoch = pb.epoch WHERE pa.f <> pb.f ORDER BY 1, 2 LIMIT 10")
def srt6(v):
    return C.matched(v.feed_a, v.feed_b).filter("a_f <> b_f").orderBy("station", "epoch").limit(10)


# Error reports ---------------------------------------------------------------------------------------------
SQL_PRED = f", p AS (SELECT *, actual_high_f + error_f AS predicted_high_f, hour({SQL_LOCAL}) AS local_hour, minute({SQL_LOCAL}) AS local_minute, month({SQL_LOCAL}) AS local_month, CAST({SQL_LOCAL} AS DATE) AS ld FROM predictions)"


def _pred(v):
    df = with_local_date(v.predictions)
    return df.select(
        "station", "seq", "epoch", "utc_minute", "actual_high_f", "error_f", "error_c", "local_date",
        (F.col("actual_high_f") + F.col("error_f")).alias("predicted_high_f"),
        F.hour("local_ts").alias("local_hour"), F.minute("local_ts").alias("local_minute"), F.month("local_ts").alias("month"),
    )


def sql_report(e: str, u: str, within, beyond=None, probs=(("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)), means=False) -> str:
    lab = lambda x: f"{x:g}".replace(".", "_")
    cols = [f"count(*) AS count", f"{r(f'avg({e})')} AS bias_mean_{u}", f"{r(f'avg(abs({e}))')} AS mae_{u}", f"{r(f'sqrt(avg({e} * {e}))')} AS rmse_{u}"]
    if means:
        cols += [f"{r('avg(actual_high_f)')} AS actual_mean_f", f"{r('avg(predicted_high_f)')} AS prediction_mean_f"]
    cols += [f"{r(f'avg(CASE WHEN abs({e}) <= {w} THEN 1.0e0 ELSE 0.0e0 END) * 100')} AS within_{lab(w)}{u}_pct" for w in within]
    if beyond:
        cols += [f"{r(f'avg(CASE WHEN {e} < -{beyond} THEN 1.0e0 ELSE 0.0e0 END) * 100')} AS under_by_more_than_{lab(beyond)}{u}_pct",
                 f"{r(f'avg(CASE WHEN {e} > {beyond} THEN 1.0e0 ELSE 0.0e0 END) * 100')} AS over_by_more_than_{lab(beyond)}{u}_pct"]
    cols += [f"{r(f'quantile_cont(abs({e}), {p})')} AS {n}_abs_error_{u}" for n, p in probs]
    return ", ".join(cols)


def _tidy_all(df, skip=()):
    return df.withColumns({f.name: tidy(F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in skip})


SQL_FULL = sql_report("error_f", "f", (1, 2, 3), 3, means=True)
SQL_SHORT = sql_report("error_f", "f", (1, 2, 3), probs=(("median", 0.5), ("p90", 0.9)))
SQL_CELSIUS = sql_report("error_c", "c", (0.5, 1, 1.5, 2))


def _full(df, keys):
    return E.error_report(df, keys, actual="actual_high_f", predicted="predicted_high_f")


@query("agg6_errors_by_hour", "predictions", SQL_PRED + f" SELECT local_hour, {SQL_FULL} FROM p GROUP BY 1")
def agg6(v):
    return _tidy_all(_full(_pred(v), ["local_hour"]))


@query("agg6_errors_by_station_hour", "predictions", SQL_PRED + f" SELECT station, local_hour, {SQL_FULL} FROM p GROUP BY 1, 2")
def agg6b(v):
    return _tidy_all(_full(_pred(v), ["station", "local_hour"]))


@query("agg7_short_errors_by_station", "predictions", SQL_PRED + f" SELECT station, {SQL_SHORT} FROM p GROUP BY 1")
def agg7(v):
    return _tidy_all(E.short_report(_pred(v), ["station"]))


@query("agg8_celsius_errors", "predictions", SQL_PRED + f" SELECT station, local_hour, {SQL_CELSIUS} FROM p GROUP BY 1, 2")
def agg8(v):
    return _tidy_all(E.celsius_report(_pred(v), ["station", "local_hour"]))


@query(
    "agg9_fit_measures", "predictions",
    SQL_PRED + f" SELECT station, {r('sqrt(avg(error_f * error_f))')} AS rmse, {r('avg(abs(error_f))')} AS mae, {r('1 - sum((predicted_high_f - actual_high_f) * (predicted_high_f - actual_high_f)) / (var_pop(actual_high_f) * count(*))')} AS r2 FROM p GROUP BY 1",
)
def agg9(v):
    return _tidy_all(E.fit_measures(_pred(v), "actual_high_f", "predicted_high_f", ["station"]))


@query(
    "agg10_residual_calibration", "predictions",
    SQL_PRED + ", m AS (SELECT station, local_month AS month, local_hour, quantile_cont(error_f, 0.5) AS med FROM p GROUP BY 1, 2, 3) SELECT p.station, m.month, p.local_hour, count(*) AS rows, "
    + r("avg(error_f)") + " AS error_mean_f, " + r("stddev_samp(error_f)") + " AS error_std_f, " + r("avg(abs(error_f))") + " AS mae_f, "
    + ", ".join(r(f"avg(CASE WHEN abs(error_f) <= {w} THEN 1.0e0 ELSE 0.0e0 END) * 100") + f" AS within_{w}f_pct" for w in (1, 2)) + f", {r('any_value(med)')} AS error_median_f, "
    + r("quantile_cont(abs(error_f - med), 0.5) * 1.4826e0") + " AS error_robust_sigma_f, " + r("quantile_cont(abs(error_f), 0.5)") + " AS median_abs_error_f"
    " FROM p JOIN m ON p.station = m.station AND p.local_month = m.month AND p.local_hour = m.local_hour GROUP BY 1, 2, 3",
)
def agg10(v):
    return _tidy_all(E.calibration(_pred(v)))


@query("agg27_approximate_errors")
def agg27(v):
    return _tidy_all(E.error_report(_pred(v), ["local_hour"], approximate=True))


@query(
    "agg25_distinct_lists", "predictions",
    SQL_PRED + " SELECT count(DISTINCT station) AS stations, count(DISTINCT local_hour) AS hours, array_to_string(list_sort(list(DISTINCT year(ld))), ',') AS years FROM p",
)
def agg25(v):
    return _pred(v).agg(
        F.countDistinct("station").alias("stations"), F.countDistinct("local_hour").alias("hours"),
        F.array_join(F.sort_array(F.collect_set(F.year("local_date"))), ",").alias("years"),
    )


@query(
    "joi14_baseline_deltas", "predictions",
    SQL_PRED + f", a AS (SELECT local_hour, {SQL_SHORT} FROM p GROUP BY 1), b AS (SELECT local_hour, {SQL_SHORT} FROM p WHERE seq % 2 = 0 AND local_hour <> 7 GROUP BY 1)"
    f" SELECT a.local_hour, a.rmse_f, b.rmse_f AS baseline_rmse_f, {r('a.rmse_f - b.rmse_f', 5)} AS rmse_delta_specialized_minus_baseline, {r('a.mae_f - b.mae_f', 5)} AS mae_delta_specialized_minus_baseline,"
    f" {r('a.median_abs_error_f - b.median_abs_error_f', 5)} AS median_abs_error_delta_specialized_minus_baseline FROM a LEFT JOIN b ON a.local_hour = b.local_hour",
)
def joi14(v):
    p = _pred(v)
    out = E.compare_with_baseline(_tidy_all(E.short_report(p, ["local_hour"])), _tidy_all(E.short_report(p.filter("seq % 2 = 0 AND local_hour <> 7"), ["local_hour"])))
    deltas = [c for c in out.columns if "delta" in c]
    return out.select("local_hour", "rmse_f", "baseline_rmse_f", *[tidy(F.col(c), 5).alias(c) for c in deltas])


# The baseline of an hour is the report of the hour before it: all predictions are read, and the first hour has none.
@query(
    "joi14_baseline_deltas_whole", "predictions",
    SQL_PRED + f", a AS (SELECT local_hour, {SQL_SHORT} FROM p GROUP BY 1), b AS (SELECT local_hour + 1 AS local_hour, {SQL_SHORT} FROM p GROUP BY 1)"
    f" SELECT a.local_hour, a.rmse_f, b.rmse_f AS baseline_rmse_f, {r('a.rmse_f - b.rmse_f', 5)} AS rmse_delta_specialized_minus_baseline, {r('a.mae_f - b.mae_f', 5)} AS mae_delta_specialized_minus_baseline,"
    f" {r('a.median_abs_error_f - b.median_abs_error_f', 5)} AS median_abs_error_delta_specialized_minus_baseline FROM a LEFT JOIN b ON a.local_hour = b.local_hour",
)
def joi14_whole(v):
    p = _pred(v)
    earlier = p.withColumn("local_hour", F.col("local_hour") + 1)
    out = E.compare_with_baseline(_tidy_all(E.short_report(p, ["local_hour"])), _tidy_all(E.short_report(earlier, ["local_hour"])))
    deltas = [c for c in out.columns if "delta" in c]
    return out.select("local_hour", "rmse_f", "baseline_rmse_f", *[tidy(F.col(c), 5).alias(c) for c in deltas])


@query(
    "joi15_win7_win8_station_ranking", "predictions",
    SQL_PRED + f", s AS (SELECT station, {SQL_FULL} FROM p GROUP BY 1), h AS (SELECT station, local_hour, {SQL_FULL} FROM p GROUP BY 1, 2),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY mae_f, rmse_f, local_hour) AS x, row_number() OVER (PARTITION BY station ORDER BY mae_f DESC, rmse_f DESC, local_hour) AS y FROM h)"
    " SELECT s.station, s.count, s.mae_f, s.rmse_f, row_number() OVER (ORDER BY s.mae_f, s.rmse_f, s.station) AS rank_by_mae, b.local_hour AS best_local_hour_by_mae, b.mae_f AS best_local_hour_mae_f,"
    " w.local_hour AS worst_local_hour_by_mae, w.mae_f AS worst_local_hour_mae_f, w.within_2f_pct AS worst_local_hour_within_2f_pct FROM s JOIN b ON s.station = b.station AND b.x = 1 JOIN b w ON s.station = w.station AND w.y = 1",
)
def joi15(v):
    p = _pred(v)
    out = E.rank_stations(_tidy_all(_full(p, ["station"])), _tidy_all(_full(p, ["station", "local_hour"])))
    return out.select("station", "count", "mae_f", "rmse_f", "rank_by_mae", "best_local_hour_by_mae", "best_local_hour_mae_f",
                      "worst_local_hour_by_mae", "worst_local_hour_mae_f", "worst_local_hour_within_2f_pct")


@query(
    "joi16_station_dimension", "obs",
    ", d AS (SELECT n_nationkey % 20 AS g, concat('N', CAST(n_nationkey AS VARCHAR)) AS name FROM nation WHERE n_nationkey < 20) SELECT seq, station, coalesce(name, '') AS city FROM obs LEFT JOIN d ON (CAST(substr(station, 2) AS BIGINT) - 100) % 25 = g",
)
def joi16(v):
    dim = v.nation.filter("n_nationkey < 20").select((F.col("n_nationkey") % 20).alias("g"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("name"))
    rows = v.obs.withColumn("g", (F.substring("station", 2, 20).cast("long") - 100) % 25)
    # The dimension is a fixed list of 25 rows at most; the planner sees its size and may broadcast it.
    return rows.join(dim, "g", "left").select("seq", "station", F.coalesce("name", F.lit("")).alias("city"))


# All rows of the dimension; the keys of some are those of no station, so the stations of these keys are unknown.
@query(
    "joi16_station_dimension_whole", "obs",
    ", d AS (SELECT n_nationkey + CASE WHEN n_nationkey < 20 THEN 0 ELSE 100 END AS g, concat('N', CAST(n_nationkey AS VARCHAR)) AS name FROM nation) SELECT seq, station, coalesce(name, '') AS city FROM obs LEFT JOIN d ON (CAST(substr(station, 2) AS BIGINT) - 100) % 25 = g",
)
def joi16_whole(v):
    dim = v.nation.select((F.col("n_nationkey") + F.when(F.col("n_nationkey") < 20, 0).otherwise(100)).alias("g"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("name"))
    rows = v.obs.withColumn("g", (F.substring("station", 2, 20).cast("long") - 100) % 25)
    return rows.join(dim, "g", "left").select("seq", "station", F.coalesce("name", F.lit("")).alias("city"))


SQL_SNAP = SQL_PRED + (
    ", mm AS (SELECT station, local_minute AS pm FROM (SELECT station, local_minute, row_number() OVER (PARTITION BY station ORDER BY count(*) DESC, min(epoch * 1000000000 + seq)) AS rk FROM p GROUP BY 1, 2) WHERE rk = 1),"
    " cand AS (SELECT station, h * 60 + (pm + o) % 60 AS tg FROM mm, (SELECT unnest(range(24)) AS h), (SELECT unnest([0, 30]) AS o)),"
    " sn AS (SELECT p.seq, p.station, any_value(p.error_c) AS error_c, first(tg ORDER BY least(abs(tg - (local_hour * 60 + local_minute)), 1440 - abs(tg - (local_hour * 60 + local_minute))), tg) AS t FROM p JOIN cand ON p.station = cand.station GROUP BY 1, 2),"
    " sl AS (SELECT seq, station, error_c, CAST(floor(t / 60) AS INT) AS scheduled_local_hour, CAST(t % 60 AS INT) AS scheduled_local_minute FROM sn)"
)


@query("win18_schedule_slots", "predictions", SQL_SNAP + " SELECT seq, station, scheduled_local_hour, scheduled_local_minute FROM sl")
def win18(v):
    return E.snap_to_schedule(_pred(v)).select("seq", "station", "scheduled_local_hour", "scheduled_local_minute")


SQL_SLOTS = SQL_SNAP + f", g AS (SELECT station, scheduled_local_hour AS local_hour, scheduled_local_minute AS local_minute, {SQL_CELSIUS} FROM sl GROUP BY 1, 2, 3)"


def _slots(v):
    snapped = E.snap_to_schedule(_pred(v))
    named = snapped.select("station", F.col("scheduled_local_hour").alias("local_hour"), F.col("scheduled_local_minute").alias("local_minute"), "error_c")
    return _tidy_all(E.celsius_report(named, ["station", "local_hour", "local_minute"]))


@query("flt9_reliable_slots", "predictions", SQL_SLOTS + " SELECT station, local_hour, local_minute, count, mae_c FROM g WHERE count >= 15 AND mae_c <= 0.4 AND within_1c_pct >= 90")
def flt9(v):
    return E.reliable(_slots(v), samples=15, mae=0.4).select("station", "local_hour", "local_minute", "count", "mae_c")


@query(
    "ml11_recommendations", "predictions",
    SQL_SLOTS + ", q AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY mae_c, rmse_c, local_hour, local_minute) AS rank FROM g WHERE count >= 10),"
    " e AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY local_hour, local_minute) AS rank FROM g WHERE count >= 10 AND mae_c <= 0.6 AND within_1c_pct >= 90)"
    " SELECT station, 'best' AS pick, rank, local_hour, local_minute, count, mae_c FROM q WHERE rank <= 5 UNION ALL SELECT station, 'earliest_reliable', rank, local_hour, local_minute, count, mae_c FROM e WHERE rank = 1",
)
def ml11(v):
    return E.recommendations(_slots(v), samples=10).select("station", "pick", "rank", "local_hour", "local_minute", "count", "mae_c")


@query(
    "win7_ranks_within_station", "predictions",
    SQL_PRED + f", h AS (SELECT station, local_hour, {SQL_CELSIUS} FROM p GROUP BY 1, 2) SELECT station, local_hour, mae_c, row_number() OVER (PARTITION BY station ORDER BY mae_c, local_hour) AS mae_rank_within_station FROM h",
)
def win7(v):
    hours = _tidy_all(E.celsius_report(_pred(v), ["station", "local_hour"]))
    w = Window.partitionBy("station").orderBy("mae_c", "local_hour")
    return hours.select("station", "local_hour", "mae_c", F.row_number().over(w).alias("mae_rank_within_station"))


@query(
    "srt5_best_worst_hour", "predictions",
    SQL_PRED + f", h AS (SELECT local_hour, {SQL_FULL} FROM p GROUP BY 1) SELECT arg_min(local_hour, mae_f) AS best_hour, min(mae_f) AS best_mae_f, arg_max(local_hour, mae_f) AS worst_hour, max(mae_f) AS worst_mae_f FROM h WHERE local_hour >= 12",
)
def srt5(v):
    hours = _tidy_all(_full(_pred(v), ["local_hour"])).filter("local_hour >= 12")
    return hours.agg(F.min_by("local_hour", "mae_f").alias("best_hour"), F.min("mae_f").alias("best_mae_f"),
                     F.max_by("local_hour", "mae_f").alias("worst_hour"), F.max("mae_f").alias("worst_mae_f"))


# Forecast drift ----------------------------------------------------------------------------------------------
FC = [f"forecast_p{i:02d}" for i in range(1, 7)]
OB = [f"observed_h{i:02d}" for i in range(1, 4)]
SQL_EXT = (
    f", e AS (SELECT *, greatest({', '.join(FC)}) AS fh, least({', '.join(FC)}) AS fl, greatest({', '.join(OB)}) AS oh, least({', '.join(OB)}) AS ol FROM snapshots),"
    " x AS (SELECT *, CASE WHEN kind = 'Highest' THEN fh ELSE fl END AS fe, CASE WHEN kind = 'Highest' THEN oh ELSE ol END AS oe FROM e)"
)


@query("arr2_row_extremes", "snapshots", SQL_EXT + " SELECT snap_id, fh AS forecast_high_calc, fl AS forecast_low_calc, oh AS observed_high_calc, ol AS observed_low_calc, fe AS forecast_extreme, oe AS observed_extreme FROM x")
def arr2(v):
    return D.with_extremes(v.snapshots).select("snap_id", "forecast_high_calc", "forecast_low_calc", "observed_high_calc", "observed_low_calc", "forecast_extreme", "observed_extreme")


@query(
    "arr3_joined_text", "snapshots",
    "SELECT snap_id, array_to_string(list_transform(list_filter([" + ", ".join(FC) + "], lambda x: x IS NOT NULL), lambda x: CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END), ' | ') AS forecast_text FROM snapshots",
)
def arr3(v):
    return D.joined_text(v.snapshots).select("snap_id", "forecast_text")


@query(
    "src4_wide_snapshots", "snapshots",
    "SELECT snap_id, city, CASE WHEN snap_id % 8 = 3 THEN NULL ELSE observed_at END AS observed_at_utc, " + ", ".join(f"CASE WHEN snap_id % 9 = {i} THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(FC + OB)) + " FROM snapshots",
)
def src4(v):
    from skytally.sources.readers import typed_snapshots

    text = v.snapshots.select(
        "snap_id", "city", F.when(F.col("snap_id") % 8 == 3, "no time").otherwise(F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss")).alias("observed_at_utc"),
        *[F.when(F.col("snap_id") % 9 == i, F.lit(["n/a", "NaN", ""][i % 3])).otherwise(F.col(c).cast("string")).alias(c) for i, c in enumerate(FC + OB)],
    )
    return typed_snapshots(text)


SQL_DRIFT = SQL_EXT + (
    ", d AS (SELECT *, fe - lag(fe) OVER s AS dp, fe - first_value(fe IGNORE NULLS) OVER (PARTITION BY city, kind ORDER BY observed_epoch, cycle_id, snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS df"
    " FROM x WINDOW s AS (PARTITION BY city, kind ORDER BY observed_epoch, cycle_id, snap_id))"
)


@query("win4_win5_drift", "snapshots", SQL_DRIFT + f" SELECT snap_id, {r('dp')} AS drift_from_prev, {r('df')} AS drift_from_first FROM d")
def win4(v):
    return D.with_drift(D.with_extremes(v.snapshots)).select("snap_id", tidy(F.col("drift_from_prev")).alias("drift_from_prev"), tidy(F.col("drift_from_first")).alias("drift_from_first"))


@query(
    "agg17_drift_summary", "snapshots",
    SQL_DRIFT + " SELECT city, kind, count(cycle_id) AS cycles, first(fe ORDER BY observed_epoch, cycle_id, snap_id) FILTER (WHERE fe IS NOT NULL) AS first_forecast, last(fe ORDER BY observed_epoch, cycle_id, snap_id) FILTER (WHERE fe IS NOT NULL) AS last_forecast,"
    f" min(fe) AS min_forecast, max(fe) AS max_forecast, {r('last(df ORDER BY observed_epoch, cycle_id, snap_id) FILTER (WHERE df IS NOT NULL)')} AS final_drift_from_first, {r('max(abs(dp))')} AS max_abs_step_drift, count(oe) AS observed_points FROM d GROUP BY 1, 2",
)
def agg17(v):
    out = D.drift_summary(D.with_drift(D.with_extremes(v.snapshots)))
    return out.withColumns({c: tidy(F.col(c)) for c in ("final_drift_from_first", "max_abs_step_drift")})


@query(
    "arr5_series_points", "snapshots",
    SQL_DRIFT + f", n AS (SELECT *, row_number() OVER (PARTITION BY city, kind ORDER BY observed_epoch, cycle_id, snap_id) AS pos FROM d) SELECT city, kind, CAST(floor((pos - 1) / 500) AS BIGINT) AS chunk, pos, cycle_id, fe AS forecast_extreme, {r('dp')} AS drift_from_prev FROM n",
)
def arr5(v):
    chunks = D.series_chunks(D.with_drift(D.with_extremes(v.snapshots)))
    p = chunks.select("city", "kind", "chunk", F.explode("points").alias("p"))
    return p.select("city", "kind", "chunk", F.col("p._n").alias("pos"), "p.cycle_id", "p.forecast_extreme", tidy(F.col("p.drift_from_prev")).alias("drift_from_prev"))


@query(
    "set4_unique_snapshots", "snapshots",
    "SELECT city, kind, cycle_id, min(snap_id) AS snap_id FROM snapshots GROUP BY 1, 2, 3",
)
def set4(v):
    return D.unique_snapshots(v.snapshots.select("city", "kind", "cycle_id", "snap_id"), ["city", "kind", "cycle_id"], ["snap_id"])


ARRAYS = ["validTimeLocal", "temperature", "relativeHumidity"]
SQL_EXPAND = (
    ", j AS (SELECT snap_id, city, target_date, TRY_CAST(payload AS JSON) AS p FROM payload_text WHERE json_valid(payload)), l AS (SELECT *, json_array_length(p, '$.validTimeLocal') AS n1, json_array_length(p, '$.temperature') AS n2, json_array_length(p, '$.relativeHumidity') AS n3 FROM j),"
    " u AS (SELECT snap_id, city, target_date, p, unnest(range(CAST(greatest(n1, n2, n3) AS BIGINT))) AS i FROM l),"
    " x AS (SELECT snap_id, city, target_date, CAST(i + 1 AS INT) AS hour_index, json_extract_string(p, '$.validTimeLocal[' || i || ']') AS validTimeLocal, json_extract_string(p, '$.temperature[' || i || ']') AS temperature, json_extract_string(p, '$.relativeHumidity[' || i || ']') AS relativeHumidity FROM u),"
    " y AS (SELECT *, coalesce(starts_with(validTimeLocal, target_date), FALSE) AS is_target_date FROM x)"
)


@query("arr1_expand_payload", "payload_text", SQL_EXPAND + " SELECT * FROM y")
def arr1(v):
    return D.expand_payload(v.payload_text, ARRAYS)


SQL_TARGET = SQL_EXPAND + (
    ", t AS (SELECT snap_id, city, max(CAST(temperature AS DOUBLE)) AS high, min(CAST(temperature AS DOUBLE)) AS low, count(temperature) AS hours, coalesce(array_to_string(list(temperature ORDER BY hour_index) FILTER (WHERE temperature IS NOT NULL), ' | '), '') AS temps,"
    " array_to_string(list(validTimeLocal ORDER BY hour_index), ' | ') AS target_hours FROM y WHERE is_target_date GROUP BY 1, 2)"
)


@query("agg18_target_day", "payload_text", SQL_TARGET + " SELECT * FROM t")
def agg18(v):
    return D.target_day(D.expand_payload(v.payload_text, ARRAYS), ["snap_id", "city"])


@query("agg19_high_distribution", "payload_text", SQL_TARGET + " SELECT high, count(*) AS n, count(*) FILTER (WHERE high >= 60) AS at_least_60 FROM t GROUP BY 1")
def agg19(v):
    days = D.target_day(D.expand_payload(v.payload_text, ARRAYS), ["snap_id", "city"])
    return days.groupBy("high").agg(F.count("*").alias("n"), F.count_if(F.col("high") >= 60).alias("at_least_60")).orderBy("high")
