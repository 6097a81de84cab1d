"""Archive parsing, report decoding, daily labels and series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally.functions import metar as M
from skytally.functions.timeparse import infer_year_date, with_iso_calendar, with_local_calendar  # noqa: F401
from skytally.functions.units import c_to_f, f_to_c, half_even, half_up, live_whole_f, tidy
from skytally.operators import observations as O
from skytally.operators.scale import earliest_by  # noqa: F401
from skytally.plans.registry import query, r
from skytally.sources.readers import flag_archive_lines, normalize_archive, parse_archive_lines, parse_station_text

# Checking-side pieces ------------------------------------------------------------------------------------
TG = r"'(?:^|\s)T([01])(\d{3})([01])(\d{3})(?:\s|$)'"
SQL_TENTHS = (
    f"CASE WHEN regexp_matches(metar, {TG}) THEN CAST(regexp_extract(metar, {TG}, 2) AS INT) / 10.0e0"
    f" * CASE WHEN regexp_extract(metar, {TG}, 1) = '1' THEN -1 ELSE 1 END END"
)
SQL_AUTO = "contains(' ' || metar || ' ', ' AUTO ')"
SQL_LOCAL = "((valid_utc AT TIME ZONE 'UTC') AT TIME ZONE tz)"
SQL_WORDS = (
    ", w AS (SELECT *, list_filter(string_split(regexp_replace(CASE WHEN contains(metar, ' RMK ') THEN"
    " split_part(metar, ' RMK ', 1) ELSE metar END, ' (\\d+) (\\S*SM)', ' \\1_\\2', 'g'), ' '), lambda x: x <> '')[2:] AS ws,"
    " CASE WHEN contains(metar, ' RMK ') THEN substr(metar, position(' RMK ' IN metar) + 5) ELSE '' END AS rem FROM metar)"
)


def last_word(pattern: str) -> str:
    return f"list_filter(ws, lambda x: regexp_full_match(x, '{pattern}'))[-1]"


WIND = r"(\d{3}|VRB)(\d{2,3})(?:G(\d{2,3}))?KT"
TEMP = r"(M?\d{2}|//)/(M?\d{2}|//)"
SQL_M = "CASE WHEN {0} = '//' THEN NULL WHEN starts_with({0}, 'M') THEN -CAST(substr({0}, 2) AS DOUBLE) ELSE CAST({0} AS DOUBLE) END"


# SRC1, SRC2, AGG5 -----------------------------------------------------------------------------------------
SQL_PARSED = (
    ", lines AS (SELECT seq, value, string_split(value, ',') AS p FROM archive_lines),"
    " timed AS (SELECT seq, value, trim(p[1]) AS station, try_strptime(trim(p[2]), '%Y-%m-%d %H:%M') AS valid_utc,"
    " trim(array_to_string(p[3:], ',')) AS metar FROM lines),"
    " parsed AS (SELECT seq, station, valid_utc, metar FROM timed WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')"
    " AND valid_utc IS NOT NULL AND metar <> '')"
)


@query("src1_scan_raw_observations", "archive_lines", SQL_PARSED + " SELECT seq, station, valid_utc, metar FROM parsed")
def src1(v):
    return parse_archive_lines(v.archive_lines).select("seq", "station", "valid_utc", "metar")


@query(
    "src2_normalize_archive", "metar",
    "SELECT seq, concat('K', substr(station, 2)) AS station, metar FROM (SELECT seq, station,"
    " CASE WHEN seq % 50 = 1 THEN ' M ' WHEN seq % 50 = 2 THEN '' WHEN seq % 50 = 3 THEN 'M M' ELSE metar END AS metar FROM metar)"
    " WHERE trim(metar) NOT IN ('', 'M')",
)
def src2(v):
    damaged = v.metar.withColumn(
        "metar",
        F.expr("CASE WHEN seq % 50 = 1 THEN ' M ' WHEN seq % 50 = 2 THEN '' WHEN seq % 50 = 3 THEN 'M M' ELSE metar END"),
    ).withColumn("station", F.substring("station", 2, 20))
    return normalize_archive(damaged.select("seq", "station", "metar"), F.concat(F.lit("K"), F.col("station")))


@query(
    "agg5_stage_counts", "archive_lines",
    SQL_PARSED + f""", z AS (SELECT *, 'America/Chicago' AS tz FROM parsed), l AS (SELECT *, {SQL_LOCAL} AS lt FROM z)
    SELECT (SELECT count(*) FROM archive_lines) AS input_lines, count(*) AS parsed_rows, count_if({SQL_AUTO}) AS auto_rows,
      count_if(NOT {SQL_AUTO} AND {SQL_TENTHS} IS NOT NULL) AS exact_rows,
      count_if(NOT {SQL_AUTO} AND hour(lt) >= 9 AND (hour(lt) < 19 OR (hour(lt) = 19 AND minute(lt) = 0 AND second(lt) = 0))) AS window_rows
    FROM l""",
)
def agg5(v):
    return O.stage_counts(flag_archive_lines(v.archive_lines).withColumn("tz", F.lit("America/Chicago")))


# PAR1, PAR2 -----------------------------------------------------------------------------------------------
@query("par1_drop_auto", "metar", f"SELECT seq, station, metar FROM metar WHERE NOT {SQL_AUTO}")
def par1(v):
    return v.metar.filter(~M.is_auto(F.col("metar"))).select("seq", "station", "metar")


@query(
    "par2_station_text", "metar",
    ", t AS (SELECT seq, valid_utc, metar, regexp_extract(metar, '\\bT([01]\\d{3})[01]\\d{3}\\b', 1) AS t,"
    " list_filter(string_split(metar, ' '), lambda x: regexp_full_match(x, '(M?\\d{2})/(?:M?\\d{2}|//)'))[1] AS b FROM metar WHERE seq % 43 <> 1)"
    " , u AS (SELECT seq, valid_utc, metar AS raw_ob, CASE WHEN t <> '' THEN CAST(substr(t, 2) AS DOUBLE) / 10.0e0 * CASE WHEN t[1] = '1' THEN -1 ELSE 1 END"
    " ELSE " + SQL_M.format("split_part(b, '/', 1)") + " END AS temp_c FROM t)"
    " SELECT seq, valid_utc, raw_ob, " + r("temp_c") + " AS temp_c FROM u WHERE temp_c IS NOT NULL",
)
def par2(v):
    text = F.concat(
        F.lit("\n"), F.when(F.col("seq") % 43 == 1, F.lit("no time")).otherwise(F.date_format("valid_utc", "yyyy/MM/dd HH:mm")),
        F.lit("\n\n"), F.col("metar"), F.lit("\n"),
    )
    return parse_station_text(v.metar.select("seq", text.alias("text"))).withColumn("temp_c", tidy(F.col("temp_c")))


# DEC1 - DEC16 ---------------------------------------------------------------------------------------------
@query(
    "dec1_tenths_temperature", "metar",
    f"SELECT seq, {r(SQL_TENTHS)} AS temp_c, "
    + r(f"CASE WHEN regexp_matches(metar, {TG}) THEN CAST(regexp_extract(metar, {TG}, 4) AS INT) / 10.0e0 * CASE WHEN regexp_extract(metar, {TG}, 3) = '1' THEN -1 ELSE 1 END END")
    + " AS dewpoint_c FROM metar",
)
def dec1(v):
    m = F.col("metar")
    return v.metar.select("seq", tidy(M.tenths_temperature(m)).alias("temp_c"), tidy(M.tenths_dewpoint(m)).alias("dewpoint_c"))


@query(
    "dec2_lenient_temperature", "metar",
    ", t AS (SELECT seq, regexp_extract(metar, '\\bT([01]\\d{3}|////)([01]\\d{3}|////)\\b', 1) AS t,"
    " regexp_extract(metar, '\\b(M?\\d{2})/(M?\\d{2})\\b', 1) AS b FROM metar)"
    " SELECT seq, " + r("CASE WHEN t NOT IN ('', '////') THEN CAST(substr(t, 2) AS DOUBLE) / 10.0e0 * CASE WHEN t[1] = '1' THEN -1 ELSE 1 END"
                        " WHEN b = '' THEN NULL WHEN b[1] = 'M' THEN -CAST(substr(b, 2) AS DOUBLE) ELSE CAST(b AS DOUBLE) END") + " AS temp_c FROM t",
)
def dec2(v):
    return v.metar.select("seq", tidy(M.lenient_temperature(F.col("metar"))).alias("temp_c"))


@query(
    "dec3_strict_temperature", "metar",
    ", t AS (SELECT seq, regexp_extract(metar, '\\bT([01]\\d{3})[01]\\d{3}\\b', 1) AS t,"
    " list_filter(string_split(metar, ' '), lambda x: regexp_full_match(x, '(M?\\d{2})/(?:M?\\d{2}|//)'))[1] AS b FROM metar)"
    " SELECT seq, " + r("CASE WHEN t <> '' THEN CAST(substr(t, 2) AS DOUBLE) / 10.0e0 * CASE WHEN t[1] = '1' THEN -1 ELSE 1 END ELSE "
                        + SQL_M.format("split_part(b, '/', 1)") + " END") + " AS temp_c FROM t",
)
def dec3(v):
    return v.metar.select("seq", tidy(M.strict_temperature(F.col("metar"))).alias("temp_c"))


SQL_TEMPS = (
    SQL_WORDS + f", b AS (SELECT *, {last_word(TEMP)} AS tw FROM w), b2 AS (SELECT *,"
    f" regexp_extract(tw, '{TEMP}', 1) AS bt, regexp_extract(tw, '{TEMP}', 2) AS bd FROM b), t AS (SELECT *,"
    f" coalesce({SQL_TENTHS}, CASE WHEN tw IS NOT NULL THEN {SQL_M.format('bt')} END) AS temp_c,"
    f" coalesce(CASE WHEN regexp_matches(metar, {TG}) THEN CAST(regexp_extract(metar, {TG}, 4) AS INT) / 10.0e0 * CASE WHEN regexp_extract(metar, {TG}, 3) = '1' THEN -1 ELSE 1 END END,"
    f" CASE WHEN tw IS NOT NULL THEN {SQL_M.format('bd')} END) AS dew_c FROM b2), tf AS (SELECT *, temp_c * 9.0e0 / 5.0e0 + 32.0e0 AS temp_f, dew_c * 9.0e0 / 5.0e0 + 32.0e0 AS dew_f,"
    " greatest(0.0e0, least(100.0e0, 100.0e0 * exp((17.625e0 * dew_c) / (243.04e0 + dew_c) - (17.625e0 * temp_c) / (243.04e0 + temp_c)))) AS rh0 FROM t),"
    " tr AS (SELECT *, CASE WHEN temp_c IS NOT NULL AND dew_c IS NOT NULL THEN rh0 END AS rh FROM tf)"
)


@query("dec4_temperature", "metar", SQL_TEMPS + f" SELECT seq, {r('temp_c')} AS temp_c, {r('dew_c')} AS dewpoint_c FROM tr")
def dec4(v):
    df = M.with_temperature(M.with_sections(v.metar))
    return df.select("seq", tidy(F.col("temp_c")).alias("temp_c"), tidy(F.col("dewpoint_c")).alias("dewpoint_c"))


SQL_WIND = (
    SQL_WORDS + f", ww AS (SELECT *, {last_word(WIND)} AS wt, " + last_word(r"\d{5,6}(?:G\d{2,3})?KT") + " AS dt FROM w), wp AS (SELECT *,"
    f" regexp_extract(wt, '{WIND}', 1) AS wd, regexp_extract(wt, '{WIND}', 2) AS wsp, regexp_extract(wt, '{WIND}', 3) AS wg,"
    f" CAST(nullif(regexp_extract(dt, '{WIND}', 1), '') AS DOUBLE) AS dd, CAST(nullif(regexp_extract(dt, '{WIND}', 2), '') AS DOUBLE) AS dk FROM ww)"
)


@query(
    "dec5_wind", "metar",
    SQL_WIND + " SELECT seq, TRY_CAST(nullif(wd, '') AS DOUBLE) AS wind_dir_degrees, CASE WHEN wt IS NOT NULL THEN CAST(wd = 'VRB' AS INT) END AS wind_variable,"
    " CAST(nullif(wsp, '') AS DOUBLE) AS wind_speed_kt, CAST(nullif(wg, '') AS DOUBLE) AS wind_gust_kt, "
    + r("CAST(nullif(wsp, '') AS DOUBLE) * 1.15078e0") + " AS wind_speed_mph, " + r("-dk * sin(radians(dd))") + " AS wind_u_kt, "
    + r("-dk * cos(radians(dd))") + " AS wind_v_kt FROM wp",
)
def dec5(v):
    df = M.with_wind(M.with_sections(v.metar))
    return df.select(
        "seq", "wind_dir_degrees", "wind_variable", "wind_speed_kt", "wind_gust_kt",
        *[tidy(F.col(c)).alias(c) for c in ("wind_speed_mph", "wind_u_kt", "wind_v_kt")],
    )


@query(
    "dec6_visibility", "metar",
    SQL_WORDS + ", x AS (SELECT seq, " + last_word(r"(?:\d+_)?\d*(?:/\d+)?SM") + " AS t FROM w), y AS (SELECT seq, t,"
    " CASE WHEN contains(t, '_') THEN CAST(split_part(t, '_', 1) AS DOUBLE) ELSE 0.0e0 END AS a,"
    " CASE WHEN contains(t, '_') THEN split_part(t, '_', 2) ELSE t END AS f FROM x)"
    " SELECT seq, " + r("CASE WHEN t IS NOT NULL THEN a + CASE WHEN contains(f, '/') THEN CAST(split_part(f, '/', 1) AS DOUBLE) / CAST(replace(split_part(f, '/', 2), 'SM', '') AS DOUBLE)"
                        " ELSE CAST(replace(f, 'SM', '') AS DOUBLE) END END") + " AS visibility_sm FROM y",
)
def dec6(v):
    return M.with_visibility(M.with_sections(v.metar)).select("seq", tidy(F.col("visibility_sm")).alias("visibility_sm"))


@query("dec7_altimeter", "metar", SQL_WORDS + " SELECT seq, " + r(f"CAST(substr({last_word('A[0-9]{4}')}, 2) AS DOUBLE) / 100.0e0") + " AS altimeter_inhg FROM w")
def dec7(v):
    return M.with_altimeter(M.with_sections(v.metar)).select("seq", tidy(F.col("altimeter_inhg")).alias("altimeter_inhg"))


def _rem(pattern: str, group: int = 1) -> str:
    return f"CAST(nullif(regexp_extract(rem, '(?:^|\\s){pattern}(?:\\s|$)', {group}), '') AS INT)"


SQL_REMARKS = (
    SQL_WORDS + f" SELECT seq, {r('s / 10.0e0 + CASE WHEN s < 500 THEN 1000.0e0 ELSE 900.0e0 END')} AS sea_level_pressure_hpa, c AS pressure_tendency_code,"
    f" {r('m / 10.0e0')} AS pressure_tendency_3h_hpa, {r('p / 100.0e0')} AS precip_1h_in FROM (SELECT seq, "
    + _rem(r"SLP(\d{3})") + " AS s, " + _rem(r"5([0-8])(\d{3})", 1) + " AS c, " + _rem(r"5([0-8])(\d{3})", 2) + " AS m, " + _rem(r"P(\d{4})") + " AS p FROM w)"
)


@query("dec8_dec9_dec10_remarks", "metar", SQL_REMARKS)
def dec8(v):
    df = M.with_remarks(M.with_sections(v.metar))
    return df.select("seq", "pressure_tendency_code", *[tidy(F.col(c)).alias(c) for c in ("sea_level_pressure_hpa", "pressure_tendency_3h_hpa", "precip_1h_in")])


_CLOUD = "regexp_matches(x, '^(FEW|SCT|BKN|OVC|VV)')"
_CLR = "x IN ('CLR', 'SKC', 'NSC')"
SQL_CLOUDS = (
    SQL_WORDS + f", c AS (SELECT seq, list_filter(ws, lambda x: {_CLR} OR {_CLOUD}) AS ls FROM w), d AS (SELECT seq, ls,"
    " list_transform(ls, lambda x: CASE WHEN x IN ('CLR','SKC','NSC') THEN 0 WHEN x[1:3] = 'FEW' THEN 1 WHEN x[1:3] = 'SCT' THEN 2 WHEN x[1:3] = 'BKN' THEN 3 ELSE 4 END) AS am,"
    " list_filter(ls, lambda x: regexp_matches(x, '^(FEW|SCT|BKN|OVC|VV)\\d{3}')) AS bs FROM c)"
    " SELECT seq, CASE WHEN len(ls) > 0 THEN CAST(len(ls) AS INT) END AS cloud_layer_count, list_max(am) AS cloud_cover_max,"
    " list_min(list_transform(bs, lambda x: CAST(regexp_extract(x, '\\d{3}') AS INT) * 100)) AS lowest_cloud_base_ft,"
    " list_min(list_transform(list_filter(bs, lambda x: regexp_matches(x, '^(BKN|OVC|VV)')), lambda x: CAST(regexp_extract(x, '\\d{3}') AS INT) * 100)) AS lowest_ceiling_ft FROM d"
)


@query("dec11_clouds", "metar", SQL_CLOUDS)
def dec11(v):
    df = M.with_clouds_and_weather(M.with_sections(v.metar))
    return df.select("seq", "cloud_layer_count", "cloud_cover_max", "lowest_cloud_base_ft", "lowest_ceiling_ft")


_TAKEN = (
    f"regexp_full_match(x, '{WIND}') OR regexp_full_match(x, '(?:\\d+_)?\\d*(?:/\\d+)?SM') OR contains(x, '_') OR regexp_full_match(x, 'A\\d{{4}}')"
    f" OR regexp_full_match(x, '{TEMP}') OR {_CLR} OR {_CLOUD}"
)


@query(
    "dec12_weather", "metar",
    SQL_WORDS + f", f AS (SELECT seq, list_filter(list_transform(list_filter(ws, lambda x: NOT ({_TAKEN})), lambda x: ltrim(x, '+-')),"
    " lambda x: regexp_matches(x, '" + "|".join(M.WEATHER_CODES) + "')) AS wx FROM w) SELECT seq, CAST(len(wx) AS INT) AS wx_token_count, "
    + ", ".join(f"CAST(len(list_filter(wx, lambda x: contains(x, '{c}'))) > 0 AS INT) AS wx_{c.lower()}" for c in M.WEATHER_CODES) + " FROM f",
)
def dec12(v):
    df = M.with_clouds_and_weather(M.with_sections(v.metar))
    return df.select("seq", "wx_token_count", *[f"wx_{c.lower()}" for c in M.WEATHER_CODES])


@query(
    "dec13_local_calendar", "obs",
    f", l AS (SELECT seq, {SQL_LOCAL} AS t FROM obs) SELECT seq, CAST(t AS DATE) AS local_date, CAST(year(t) AS INT) AS local_year, CAST(month(t) AS INT) AS local_month,"
    " CAST(day(t) AS INT) AS local_day, CAST(dayofyear(t) AS INT) AS local_day_of_year, CAST(isodow(t) - 1 AS INT) AS local_day_of_week, CAST(hour(t) AS INT) AS local_hour,"
    " CAST(minute(t) AS INT) AS local_minute, CAST(hour(t) * 60 + minute(t) AS INT) AS local_minutes_since_midnight,"
    + ", ".join(f" {r(f'{f}(2.0e0 * pi() * {x})')} AS {n}" for f, x, n in [
        ("sin", "(hour(t) * 60 + minute(t)) / 1440.0e0", "local_hour_sin"), ("cos", "(hour(t) * 60 + minute(t)) / 1440.0e0", "local_hour_cos"),
        ("sin", "dayofyear(t) / 366.0e0", "local_doy_sin"), ("cos", "dayofyear(t) / 366.0e0", "local_doy_cos")]) + " FROM l",
)
def dec13(v):
    df = with_local_calendar(v.obs)
    whole = "local_date local_year local_month local_day local_day_of_year local_day_of_week local_hour local_minute local_minutes_since_midnight".split()
    return df.select("seq", *whole, *[tidy(F.col(c)).alias(c) for c in ("local_hour_sin", "local_hour_cos", "local_doy_sin", "local_doy_cos")])


_HI = ("-42.379 + 2.04901523 * temp_f + 10.14333127 * rh - 0.22475541 * temp_f * rh - 0.00683783 * temp_f * temp_f - 0.05481717 * rh * rh"
       " + 0.00122874 * temp_f * temp_f * rh + 0.00085282 * temp_f * rh * rh - 0.00000199 * temp_f * temp_f * rh * rh")


@query("dec14_humidity", "metar", SQL_TEMPS + f" SELECT seq, {r('rh')} AS relative_humidity_pct FROM tr")
def dec14(v):
    return M.with_temperature(M.with_sections(v.metar)).select("seq", tidy(F.col("relative_humidity_pct")).alias("relative_humidity_pct"))


@query(
    "dec15_apparent_temperature", "metar",
    SQL_TEMPS + f", q AS (SELECT *, {last_word(WIND)} AS wt FROM tr), q2 AS (SELECT *, CAST(nullif(regexp_extract(wt, '{WIND}', 2), '') AS DOUBLE) * 1.15078e0 AS mph FROM q) SELECT seq, "
    + r(f"CASE WHEN temp_f >= 80 AND rh IS NOT NULL THEN {_HI} END", 4) + " AS heat_index_f, "
    + r("CASE WHEN temp_f <= 50 AND mph >= 3 THEN 35.74 + 0.6215 * temp_f - 35.75 * pow(mph, 0.16) + 0.4275 * temp_f * pow(mph, 0.16) END", 4) + " AS wind_chill_f FROM q2",
)
def dec15(v):
    df = M.with_temperature(M.with_wind(M.with_sections(v.metar)))
    return df.select("seq", tidy(F.col("heat_index_f"), 4).alias("heat_index_f"),
                     tidy(M.wind_chill(F.col("temp_f"), F.col("wind_speed_mph")), 4).alias("wind_chill_f"))


@query("dec16_spread", "metar", SQL_TEMPS + f" SELECT seq, {r('temp_f')} AS temp_f, {r('dew_f')} AS dewpoint_f, {r('temp_c - dew_c')} AS temp_dewpoint_spread_c FROM tr")
def dec16(v):
    df = M.with_temperature(M.with_sections(v.metar))
    return df.select("seq", *[tidy(F.col(c)).alias(c) for c in ("temp_f", "dewpoint_f", "temp_dewpoint_spread_c")])


@query("dec_decode_metar")
def decode_all(v):
    return M.decode(v.metar)


# PRJ1, PRJ2, PRJ4, PRJ5, SNK7 -------------------------------------------------------------------------------
@query("prj1_units", "obs", f"SELECT seq, {r('tenths / 10.0e0 * 9.0e0 / 5.0e0 + 32.0e0')} AS f, {r('(k / 100.0e0 - 32.0e0) * 5.0e0 / 9.0e0')} AS c FROM obs")
def prj1(v):
    return v.obs.select("seq", tidy(c_to_f(F.col("tenths") / 10.0)).alias("f"), tidy(f_to_c(F.col("k") / 100.0)).alias("c"))


@query(
    "prj2_rounding", "obs",
    "SELECT seq, CAST(floor(k / 10.0e0 + 0.5e0) AS BIGINT) AS up, CAST(floor(-k / 10.0e0 + 0.5e0) AS BIGINT) AS down, CAST(round_even(k / 10.0e0, 0) AS BIGINT) AS even,"
    " CAST(round_even(((tenths / 10.0e0 * 9.0e0 / 5.0e0 + 32.0e0) - 32.0e0) * 5.0e0 / 9.0e0 * 9.0e0 / 5.0e0 + 32.0e0, 0) AS BIGINT) AS live_f FROM obs",
)
def prj2(v):
    x = F.col("k") / 10.0
    return v.obs.select("seq", half_up(x).alias("up"), half_up(-x).alias("down"), half_even(x).alias("even"), live_whole_f(F.col("tenths") / 10.0).alias("live_f"))


@query(
    "prj4_iso_calendar", "obs",
    ", d AS (SELECT seq, CAST(1990 + k % 60 AS INT) AS y, CAST(1 + k % 12 AS INT) AS m, CAST(1 + seq % 31 AS INT) AS dd FROM obs), e AS (SELECT seq,"
    " TRY_CAST(concat(CAST(y AS VARCHAR), '-', lpad(CAST(m AS VARCHAR), 2, '0'), '-', lpad(CAST(dd AS VARCHAR), 2, '0')) AS DATE) AS d FROM d)"
    " SELECT seq, CAST(weekofyear(d) AS INT) AS iso_week, CAST(isoyear(d) AS INT) AS iso_year, CAST(isodow(d) AS INT) AS iso_weekday FROM e",
)
def prj4(v):
    d = v.obs.select("seq", F.expr("CAST(1990 + k % 60 AS INT) AS local_year"), F.expr("CAST(1 + k % 12 AS INT) AS local_month"), F.expr("CAST(1 + seq % 31 AS INT) AS local_day"))
    return with_iso_calendar(d).select("seq", "iso_week", "iso_year", "iso_weekday")


@query(
    "snk7_six_digit_text", "obs",
    ", x AS (SELECT seq, CASE WHEN seq % 17 = 1 THEN NULL ELSE k / 8.0e0 END AS a, k / 100.0e0 AS b FROM obs) SELECT seq, "
    + ", ".join(f"coalesce(printf('%.6g', {c}), '') AS {c}" for c in "ab") + " FROM x",
)
def snk7(v):
    from skytally.sources.sinks import six_digits

    x = v.obs.select("seq", F.when(F.col("seq") % 17 != 1, F.col("k") / 8.0).alias("a"), (F.col("k") / 100.0).alias("b"))
    return x.select("seq", six_digits(F.col("a")).alias("a"), six_digits(F.col("b")).alias("b"))


# AGG1, JOI1, FLT1, AGG3, FLT4, AGG4 -------------------------------------------------------------------------
SQL_HIGHS = (
    f", r AS (SELECT *, {SQL_LOCAL} AS lt, {SQL_TENTHS} AS t FROM metar WHERE NOT {SQL_AUTO}),"
    " hi AS (SELECT station, CAST(lt AS DATE) AS local_date, max(t) AS high_c, count(*) AS reports FROM r WHERE t IS NOT NULL GROUP BY 1, 2)"
)
_IN = "hour(lt) >= 9 AND (hour(lt) < 19 OR (hour(lt) = 19 AND minute(lt) = 0 AND second(lt) = 0))"


@query("agg1_daily_high", "metar", SQL_HIGHS + f" SELECT station, local_date, {r('high_c')} AS high_c, reports FROM hi")
def agg1(v):
    return O.daily_highs(v.metar).withColumn("high_c", tidy(F.col("high_c")))


@query(
    "joi1_label_rows", "metar",
    SQL_HIGHS + f" SELECT r.seq, r.station, r.valid_utc, r.metar, {r('high_c * 9.0e0 / 5.0e0 + 32.0e0', 1)} AS daily_high_f FROM r JOIN hi"
    f" ON r.station = hi.station AND CAST(r.lt AS DATE) = hi.local_date WHERE {_IN}",
)
def joi1(v):
    return O.label_rows(v.metar).select("seq", "station", "valid_utc", "metar", tidy(F.col("daily_high_f"), 1).alias("daily_high_f"))


@query("flt1_hour_window", "obs", f", r AS (SELECT *, {SQL_LOCAL} AS lt FROM obs) SELECT seq, station FROM r WHERE {_IN}")
def flt1(v):
    return O.with_local_date(v.obs).filter(O.in_hour_window(F.col("local_ts"), 9, 19)).select("seq", "station")


@query(
    "flt2_date_range", "obs",
    f", r AS (SELECT *, {SQL_LOCAL} AS lt FROM obs) SELECT seq, CAST(valid_utc AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS in_utc,"
    " CAST(lt AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS in_local FROM r WHERE CAST(valid_utc AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-21'",
)
def flt2(v):
    lo, hi = F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")
    near = v.obs.filter((F.col("valid_utc") >= "2024-01-05") & (F.col("valid_utc") < "2024-01-22"))
    return O.with_local_date(near).select("seq", F.to_date("valid_utc").between(lo, hi).alias("in_utc"), F.col("local_date").between(lo, hi).alias("in_local"))


@query("flt3_no_future", "obs", f", r AS (SELECT *, {SQL_LOCAL} AS lt FROM obs) SELECT seq, station FROM r WHERE lt <= TIMESTAMP '2024-01-17 12:00:00'")
def flt3(v):
    return O.with_local_date(v.obs).filter(F.col("local_ts") <= F.lit("2024-01-17 12:00:00").cast("timestamp")).select("seq", "station")


SQL_MODAL = (
    ", c AS (SELECT station, year(valid_utc) AS y, utc_minute, count(*) AS n, min(epoch * 1000000000 + seq) AS f FROM metar GROUP BY 1, 2, 3),"
    " mm AS (SELECT station, y, utc_minute AS regular_minute, n FROM (SELECT *, row_number() OVER (PARTITION BY station, y ORDER BY n DESC, f) AS rk FROM c) WHERE rk = 1)"
)


@query("agg3_modal_minute", "metar", SQL_MODAL + " SELECT station, CAST(y AS INT) AS utc_year, regular_minute, n AS regular_count FROM mm")
def agg3(v):
    return O.modal_minutes(v.metar.withColumn("utc_year", F.year("valid_utc")))


SQL_EXTRA = SQL_MODAL + (
    ", x AS (SELECT m.*, (m.utc_minute <> mm.regular_minute OR contains(' ' || m.metar || ' ', ' COR ')) AS is_extra"
    " FROM metar m LEFT JOIN mm ON m.station = mm.station AND year(m.valid_utc) = mm.y)"
)


@query("flt4_extra_reports", "metar", SQL_EXTRA + " SELECT seq, station, is_extra FROM x")
def flt4(v):
    return O.mark_extra(v.metar).select("seq", "station", "is_extra")


@query(
    "agg4_report_schedule", "obs",
    """, t AS (SELECT DISTINCT station, valid_utc FROM obs), c AS (SELECT station, minute(valid_utc) AS mi, count(*) AS n FROM t GROUP BY 1, 2),
    s AS (SELECT station, max(valid_utc) AS latest, count(*) AS report_count, greatest(1, least(6, CAST(floor(count(*) / 720) AS INT))) AS k FROM t GROUP BY 1),
    rk AS (SELECT c.station, mi, row_number() OVER (PARTITION BY c.station ORDER BY n DESC, mi) AS p FROM c),
    sel AS (SELECT rk.station, list(mi ORDER BY mi) AS ms FROM rk JOIN s ON rk.station = s.station AND rk.p <= s.k GROUP BY 1),
    f AS (SELECT s.station, latest, report_count, ms, greatest(60, CAST(floor(3600 / len(ms)) AS INT)) AS iv FROM s JOIN sel ON s.station = sel.station),
    nx AS (SELECT station, min(cand) AS e FROM (SELECT f.station, f.latest, date_trunc('hour', f.latest) + to_hours(h) + to_minutes(m.mi) AS cand FROM f, (SELECT unnest([0, 1, 2]) AS h) hh, (SELECT station, unnest(ms) AS mi FROM f) m WHERE m.station = f.station) WHERE cand > latest GROUP BY 1)
    SELECT f.station, latest, iv AS interval_seconds, report_count, array_to_string(ms, ',') AS scheduled_minutes, coalesce(e, latest + to_seconds(iv)) AS expected_next FROM f LEFT JOIN nx ON f.station = nx.station""",
)
def agg4(v):
    return O.report_schedule(v.obs, hours=720)


# WIN1, WIN2, WIN3, JOI2, JOI3, JOI4 -------------------------------------------------------------------------
SQL_SERIES = SQL_EXTRA + (
    f", s AS (SELECT x.*, {SQL_LOCAL} AS lt, CAST({SQL_LOCAL} AS DATE) AS ld, o.tenths / 10.0e0 * 9.0e0 / 5.0e0 + 32.0e0 AS t FROM x JOIN (SELECT seq, tenths FROM obs) o USING (seq))"
)


def _series(v):
    temps = v.obs.select("seq", c_to_f(F.col("tenths") / 10.0).alias("temp_f"))
    rows = O.with_local_date(O.mark_extra(v.metar))
    return rows.join(temps, "seq").select("station", "local_date", "epoch", "seq", "temp_f", "is_extra", "valid_utc")


def _temps(v):
    """The same series where extra reports do not matter: no report text is needed."""
    rows = O.with_local_date(v.obs).withColumn("temp_f", c_to_f(F.col("tenths") / 10.0))
    return rows.select("station", "local_date", "epoch", "seq", "temp_f", F.lit(False).alias("is_extra"))


@query(
    "win1_day_running", "obs metar",
    SQL_SERIES + f" SELECT seq, {r('min(t) OVER d')} AS day_min_so_far_f, {r('max(t) OVER d')} AS day_max_so_far_f FROM s"
    " WINDOW d AS (PARTITION BY station, ld ORDER BY epoch, seq ROWS UNBOUNDED PRECEDING)",
)
def win1(v):
    return O.with_day_running(_temps(v)).select("seq", *[tidy(F.col(c)).alias(c) for c in ("day_min_so_far_f", "day_max_so_far_f")])


def _ctx(cond: str, p: str) -> str:
    f = f"FILTER (WHERE b.t IS NOT NULL AND {cond})"
    return (
        f"count(b.t) {f} AS {p}_count, {r(f'max(b.t) {f}')} AS {p}_max_temp_f, {r(f'(a.epoch - first(b.epoch ORDER BY b.t DESC, b.epoch) {f}) / 60.0e0')} AS {p}_max_temp_minutes_ago,"
        f" {r(f'min(b.t) {f}')} AS {p}_min_temp_f, {r(f'(a.epoch - first(b.epoch ORDER BY b.t, b.epoch) {f}) / 60.0e0')} AS {p}_min_temp_minutes_ago,"
        f" {r(f'first(b.t ORDER BY b.epoch DESC, b.seq DESC) {f}')} AS {p}_latest_temp_f, {r(f'(a.epoch - max(b.epoch) {f}) / 60.0e0')} AS {p}_latest_temp_minutes_ago"
    )


SQL_PAIRS = " FROM s a JOIN s b ON a.station = b.station AND b.epoch BETWEEN a.epoch - 21600 AND a.epoch GROUP BY a.seq, a.epoch, a.t"
CTX = "count max_temp_f max_temp_minutes_ago min_temp_f min_temp_minutes_ago latest_temp_f latest_temp_minutes_ago".split()


def _six(df, names):
    return [F.col(c).cast("long").alias(c) if c.endswith("count") else tidy(F.col(c)).alias(c) for c in names]


@query("win2_lookback_context", "obs metar", SQL_SERIES + " SELECT a.seq, " + _ctx("TRUE", "obs") + f", {r('max(b.t) - min(b.t)')} AS obs_temp_range_f" + SQL_PAIRS)
def win2(v):
    df = O.series_features(_temps(v), lag_hours=0)
    return df.select("seq", *_six(df, [f"obs_{c}" for c in CTX] + ["obs_temp_range_f"]))


@query(
    "win3_extra_context", "obs metar",
    SQL_SERIES + " SELECT a.seq, " + _ctx("b.is_extra", "extra") + ", CAST(count(b.t) FILTER (WHERE b.is_extra) > 0 AS INT) AS has_extra, "
    + ", ".join(f"{r(f'a.t - {e}')} AS temp_f_change_from_{n}_extra" for n, e in [
        ("latest", "first(b.t ORDER BY b.epoch DESC, b.seq DESC) FILTER (WHERE b.t IS NOT NULL AND b.is_extra)"),
        ("max", "max(b.t) FILTER (WHERE b.is_extra)"), ("min", "min(b.t) FILTER (WHERE b.is_extra)")]) + SQL_PAIRS,
)
def win3(v):
    df = O.series_features(_series(v), lag_hours=0)
    return df.select("seq", "has_extra", *_six(df, [f"extra_{c}" for c in CTX] + [f"temp_f_change_from_{n}_extra" for n in ("latest", "max", "min")]))


@query(
    "joi2_previous_day", "obs metar",
    SQL_SERIES + f", d AS (SELECT station, ld, max(t) AS h, min(t) AS l FROM s GROUP BY 1, 2) SELECT s.seq, {r('h')} AS previous_local_day_high_f, {r('l')} AS previous_local_day_low_f"
    " FROM s LEFT JOIN d ON s.station = d.station AND d.ld + 1 = s.ld",
)
def joi2(v):
    df = O.series_features(_temps(v), lag_hours=0)
    return df.select("seq", *[tidy(F.col(c)).alias(c) for c in ("previous_local_day_high_f", "previous_local_day_low_f")])


def _lag_sql(step: int, name: str) -> str:
    """Neighbour rows around the target time: first at or after it, last before it."""
    return (
        f", n{name} AS (SELECT a.seq, first(struct_pack(e := b.epoch, t := b.t) ORDER BY b.epoch, b.seq) FILTER (WHERE b.epoch >= a.epoch - {step}) AS af,"
        f" first(struct_pack(e := b.epoch, t := b.t) ORDER BY b.epoch DESC, b.seq DESC) FILTER (WHERE b.epoch < a.epoch - {step}) AS bf, a.epoch - {step} AS tg"
        f" FROM s a JOIN s b ON a.station = b.station AND b.epoch BETWEEN a.epoch - {step} - 1800 AND a.epoch - {step} + 1800 GROUP BY a.seq, a.epoch),"
        f" l{name} AS (SELECT seq, CASE WHEN af.t IS NOT NULL AND (bf.t IS NULL OR af.e - tg <= tg - bf.e) THEN af.t ELSE bf.t END AS v FROM n{name})"
    )


@query(
    "joi3_hour_lags", "obs metar",
    SQL_SERIES + "".join(_lag_sql(h * 3600, f"{h}h") for h in range(1, 7)) + " SELECT s.seq, " + ", ".join(f"{r(f'l{h}h.v')} AS lag_{h}h, {r(f's.t - l{h}h.v')} AS change_{h}h" for h in range(1, 7))
    + " FROM s " + " ".join(f"LEFT JOIN l{h}h ON s.seq = l{h}h.seq" for h in range(1, 7)),
)
def joi3(v):
    df = O.series_features(_temps(v), lag_hours=6)
    return df.select("seq", *[tidy(F.col(f"{p}_{h}h")).alias(f"{p}_{h}h") for h in range(1, 7) for p in ("lag", "change")])


_HALF = list(range(1, 20, 2))


@query(
    "joi4_half_hour_lags", "obs metar",
    SQL_SERIES + "".join(_lag_sql(m * 1800, f"{m * 30}m") for m in _HALF) + " SELECT s.seq, " + ", ".join(f"{r(f's.t - l{m * 30}m.v')} AS change_{m * 30}m" for m in _HALF)
    + " FROM s " + " ".join(f"LEFT JOIN l{m * 30}m ON s.seq = l{m * 30}m.seq" for m in _HALF),
)
def joi4(v):
    df = O.series_features(_temps(v), lag_hours=0, half_hour_lags=19)
    return df.select("seq", *[tidy(F.col(f"change_{m * 30}m")).alias(f"change_{m * 30}m") for m in _HALF])
