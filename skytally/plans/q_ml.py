"""Splits, model training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally.functions import metar as M
from skytally.functions.timeparse import with_local_calendar
from skytally.functions.units import tidy
from skytally.ml import splits as S
from skytally.ml import train as TR
from skytally.operators import features as FT
from skytally.operators import observations as O
from skytally.plans.q_observations import SQL_AUTO, SQL_LOCAL, SQL_TENTHS
from skytally.plans.registry import query, r
from skytally.session import stored


def _years(v):
    return v.trades.select("trade_id", F.year("opened_at").alias("local_year"), (F.weekday("opened_at") + 1).alias("local_iso_day_of_week"))


@query("ml1_recent_year_split", "trades", ", y AS (SELECT DISTINCT year(opened_at) AS y FROM trades), c AS (SELECT y AS cut FROM y ORDER BY y DESC LIMIT 1 OFFSET (SELECT CAST(ceil(count(*) * 0.2) AS INT) - 1 FROM y)) SELECT trade_id, CASE WHEN year(opened_at) >= (SELECT cut FROM c) THEN 'validation' ELSE 'train' END AS split FROM trades")
def ml1(v):
    return S.recent_years(_years(v)).select("trade_id", "split")


@query(
    "ml2_rolling_year_blocks", "trades",
    "SELECT trade_id, CASE WHEN year(opened_at) IN (2000, 1997) THEN 'validation' WHEN year(opened_at) IN (1999, 1998, 1996, 1995) THEN 'train' END AS split, CAST(CASE WHEN year(opened_at) BETWEEN 1998 AND 2000 THEN 2000 WHEN year(opened_at) BETWEEN 1995 AND 1997 THEN 1997 END AS INT) AS block FROM trades",
)
def ml2(v):
    return S.rolling_blocks(_years(v), 2000, 2).select("trade_id", "split", "block")


@query("ml3_weekly_holdout", "trades", "SELECT trade_id, CASE WHEN isodow(opened_at) = 4 THEN 'validation' ELSE 'train' END AS split FROM trades")
def ml3(v):
    return S.weekly_holdout(_years(v), 4).select("trade_id", "split")


FEATURES = "temp_f dewpoint_f wind_speed_kt local_hour local_hour_sin local_hour_cos local_month local_day local_day_of_year local_doy_sin local_doy_cos day_max_so_far_f previous_local_day_high_f".split()


def _training(v):
    """Feature rows of labelled days; days of the month stand in for years in the split."""
    decoded = M.with_temperature(M.with_wind(M.with_sections(O.mark_extra(v.metar)))).drop("body", "remarks")
    rows = with_local_calendar(decoded)
    keep = [f for f in FEATURES if f in rows.columns]
    rows = stored(rows.select("station", "seq", "epoch", "valid_utc", "local_date", "local_minute", "is_extra", *keep), "decoded")
    rows = O.series_features(rows, lag_hours=0)
    highs = O.daily_highs(v.metar).select("station", "local_date", (F.col("high_c") * 9 / 5 + 32).alias("daily_high_f"))
    return rows.join(highs, ["station", "local_date"]).withColumn("split", F.when(F.col("local_day") > 24, "validation").otherwise("train"))


CALENDAR = {"local_month": "month(opened_at)", "local_day": "day(opened_at)", "local_day_of_year": "dayofyear(opened_at)", "local_week_of_year": "weekofyear(opened_at)", "yes_price": "yes_price", "shares": "shares"}
SQL_SETS = [(n, c) for n in S.VARIANT_DROPS for c in S.feature_columns(list(CALENDAR), n)]


@query(
    "ml4_feature_coverage", "trades",
    ", k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({e}) AS known FROM trades" for c, e in CALENDAR.items()) + "), s AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', '{c}')" for n, c in SQL_SETS) + ") AS t(variant, feature)) SELECT variant, s.feature, known FROM s JOIN k ON s.feature = k.feature",
)
def ml4(v):
    """Known values per feature of each calendar variant, from one pass over the table."""
    counts = v.trades.agg(*[F.count(F.expr(e)).alias(c) for c, e in CALENDAR.items()])
    pairs = [F.struct(F.lit(n).alias("variant"), F.lit(c).alias("feature"), F.col(c).alias("known"))
             for n in S.VARIANT_DROPS for c in S.feature_columns(list(CALENDAR), n)]
    return counts.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


@query("ml5_ml7_train_and_score")
def ml5(v):
    data = stored(_training(v), "training")
    best, _ = TR.best_variant(data, FEATURES)
    scored = TR.score(data.filter("split = 'validation'"), best.model, best.features, observed="day_max_so_far_f")
    return scored.select("seq", "station", "local_hour", "daily_high_f", tidy(F.col("predicted_high_f")).alias("predicted_high_f"))


@query("ml10_class_probabilities")
def ml10(v):
    data = stored(_training(v), "training")
    model, low, cols = TR.train_classifier(data.filter("split = 'train'"), FEATURES)
    return TR.class_probabilities(data.filter("split = 'validation'"), model, low, cols, ["seq", "station"])


@query("ml8_live_feature_rows")
def ml8(v):
    return TR.live_rows(_training(v), O.report_schedule(v.obs, hours=720), 9, 19).select("station", "seq", "valid_utc", *FEATURES)


SQL_LABELLED = (
    f", hi AS (SELECT station, CAST({SQL_LOCAL} AS DATE) AS d, max({SQL_TENTHS}) AS h FROM metar WHERE NOT {SQL_AUTO} AND {SQL_TENTHS} IS NOT NULL GROUP BY 1, 2),"
    f" lb AS (SELECT m.*, {SQL_LOCAL} AS lt, CAST({SQL_LOCAL} AS DATE) AS ld FROM metar m JOIN hi ON m.station = hi.station AND CAST({SQL_LOCAL} AS DATE) = hi.d WHERE NOT {SQL_AUTO}"
    f" AND hour({SQL_LOCAL}) >= 9 AND (hour({SQL_LOCAL}) < 19 OR (hour({SQL_LOCAL}) = 19 AND minute({SQL_LOCAL}) = 0))),"
    " c AS (SELECT station, utc_minute, count(*) AS n, min(epoch * 1000000000 + seq) AS f FROM lb GROUP BY 1, 2), mm AS (SELECT station, first(utc_minute ORDER BY n DESC, f) AS um FROM c GROUP BY 1),"
    f" x AS (SELECT lb.*, utc_minute <> um OR contains(' ' || lb.metar || ' ', ' COR ') AS ex, coalesce({SQL_TENTHS.replace('metar', 'lb.metar')},"
    " (SELECT CASE WHEN starts_with(w, 'M') THEN -CAST(substr(w, 2) AS DOUBLE) ELSE CAST(w AS DOUBLE) END FROM (SELECT nullif(regexp_extract(split_part(lb.metar, ' RMK ', 1), ' (M?[0-9][0-9])/(M?[0-9][0-9]) ', 1), '') AS w))) * 9.0e0 / 5.0e0 + 32.0e0 AS t"
    " FROM lb JOIN mm ON lb.station = mm.station)"
)


@query(
    "snk1_feature_table", "metar",
    SQL_LABELLED + f" SELECT a.seq, {r('any_value(a.t)')} AS temp_f, CAST(any_value(a.ex) AS INT) AS is_extra_metar_report, count(b.t) AS metar_obs_count_past_6h, {r('max(b.t)')} AS metar_obs_max_temp_f_past_6h,"
    f" count(b.t) FILTER (WHERE b.ex) AS extra_metar_count_past_6h, {r('CASE WHEN hour(any_value(a.lt)) < 15 THEN min(b.t) FILTER (WHERE b.ld = a.ld AND (b.epoch < a.epoch OR (b.epoch = a.epoch AND b.seq <= a.seq))) END')} AS six_hour_day_min"
    " FROM x a JOIN x b ON a.station = b.station AND b.epoch BETWEEN a.epoch - 21600 AND a.epoch GROUP BY a.seq",
)
def snk1(v):
    """In-window labelled rows through the whole feature job; a handful of its columns are compared."""
    labelled = O.label_rows(v.metar).withColumn("station_id", F.substring("station", 2, 20).cast("int"))
    labelled = stored(labelled.select("station", "station_id", "tz", "seq", "valid_utc", "metar", "daily_high_f"), "labelled")
    rows = FT.feature_table(labelled)
    six = F.when(F.col("local_hour") < 15, F.col("current_local_day_min_temp_f_so_far"))
    out = rows.select("seq", tidy(F.col("temp_f")).alias("temp_f"), "is_extra_metar_report", F.col("metar_obs_count_past_6h").cast("long").alias("metar_obs_count_past_6h"),
                      tidy(F.col("metar_obs_max_temp_f_past_6h")).alias("metar_obs_max_temp_f_past_6h"), F.col("extra_metar_count_past_6h").cast("long").alias("extra_metar_count_past_6h"), "local_hour",
                      tidy(six).alias("six_hour_day_min"))
    return out.drop("local_hour")
