"""Readers. Each has a ``parse_*`` half on DataFrames and a ``scan_*`` half that adds the file reader."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skytally import schemas
from skytally.functions import metar as M
from skytally.functions.market import pick_by_outcome
from skytally.functions.scalars import finite_double, nan_to_null
from skytally.functions.timeparse import first_utc, report_time
from skytally.session import prepare


# --- weather archives ----------------------------------------------------------------------------------
def flag_archive_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``station,valid,metar`` lines as columns with ``parsed``: false for blank, comment, header and
    bad-time lines. The report may hold commas."""
    parts = F.split(F.col(value), ",", 3)
    out = lines.select(
        *[c for c in lines.columns if c != value],
        F.trim(F.get(parts, F.lit(0))).alias("station"),
        report_time(F.get(parts, F.lit(1))).alias("valid_utc"),
        F.trim(F.get(parts, F.lit(2))).alias("metar"),
        F.trim(F.col(value)).alias("_line"),
    )
    good = (F.col("_line") != "") & ~F.col("_line").startswith("#") & F.col("valid_utc").isNotNull() & (F.col("metar") != "")
    return out.withColumn("parsed", F.coalesce(good, F.lit(False))).drop("_line")


def parse_archive_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return flag_archive_lines(lines, value).filter("parsed").drop("parsed")


def scan_raw_observations(spark: SparkSession, root: str, stations: Sequence[str] | None = None) -> DataFrame:
    """``root/STATION/STATION_YEAR_metar.csv``; naming stations reads only their folders."""
    prepare(spark)
    paths = [f"{root}/{s}/*_metar.csv" for s in stations] if stations else [f"{root}/*/*_metar.csv"]
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_archive_lines(lines)


def normalize_archive(df: DataFrame, icao: str | Column) -> DataFrame:
    """Drop empty reports and those that are just ``M``; stamp the four-letter code."""
    code = F.lit(icao) if isinstance(icao, str) else icao
    metar = F.trim("metar")
    keep = metar.isNotNull() & (metar != "") & (metar != "M")
    return df.filter(keep).select(*[c for c in df.columns if c not in ("station", "metar")], code.alias("station"), metar.alias("metar"))


def scan_archive_csv(spark: SparkSession, path: str, icao: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema="station string, valid string, metar string")
    return normalize_archive(raw, icao).select("station", report_time(F.col("valid")).alias("valid_utc"), "metar")


def scan_labelled(spark: SparkSession, root: str) -> DataFrame:
    """Labelled rows; feature files beside them are skipped."""
    df = spark.read.csv(root, header=True, schema=schemas.LABELLED, recursiveFileLookup=True, pathGlobFilter="*.csv")
    df = df.filter(~F.col("_metadata.file_name").endswith("_features.csv"))
    return df.withColumn("valid_utc", report_time(F.col("valid")))


def labelled_files(df: DataFrame) -> Column:
    return ~F.col("_metadata.file_name").endswith("_features.csv")


# --- snapshots -------------------------------------------------------------------------------------------
FORECAST_COLUMN = re.compile(r"forecast_p\d{2}")
OBSERVED_COLUMN = re.compile(r"observed_h\d{2}")


def pattern_columns(df: DataFrame, pattern: re.Pattern) -> list[str]:
    return [c for c in df.columns if pattern.fullmatch(c)]


def typed_snapshots(df: DataFrame, times: Sequence[str] = ("observed_at_utc",), numbers: Sequence[str] = ()) -> DataFrame:
    """Pattern-named columns as numbers, times as timestamps; what does not parse is null."""
    wide = pattern_columns(df, FORECAST_COLUMN) + pattern_columns(df, OBSERVED_COLUMN)
    numeric = [c for c in [*wide, *numbers] if c in df.columns]
    fixed = {c: finite_double(F.col(c)) for c in numeric}
    fixed |= {t: F.try_to_timestamp(F.col(t).cast("string")) for t in times if t in df.columns}
    return df.withColumns(fixed)


def scan_wide_snapshots(spark: SparkSession, path: str, keep: Sequence[str] = schemas.SNAPSHOT_COLUMNS) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns})
    wide = pattern_columns(raw, FORECAST_COLUMN) + pattern_columns(raw, OBSERVED_COLUMN)
    chosen = [c for c in keep if c in raw.columns] + wide
    return typed_snapshots(raw.select(*chosen), numbers=("combined_high", "combined_low"))


# --- ledgers, calibration, predictions ------------------------------------------------------------------
def typed_ledger(df: DataFrame, schema: T.StructType = schemas.LEDGER, optional=schemas.LEDGER_OPTIONAL) -> DataFrame:
    """Text ledger to types: optional numbers stay null, other numbers default to 0, side to YES."""
    have = {c.lstrip("﻿"): c for c in df.columns}
    out = []
    for f in schema.fields:
        source = F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None).cast("string")
        if isinstance(f.dataType, T.DoubleType):
            number = F.trim(source).try_cast("double")
            col = number if f.name in optional else F.coalesce(number, F.lit(0.0))
        else:
            default = "YES" if f.name == "position_side" else ""
            col = F.when(F.coalesce(source, F.lit("")) != "", source).otherwise(F.lit(default))
        out.append(col.alias(f.name))
    return df.select(*out)


def scan_ledger(spark: SparkSession, path: str, schema: T.StructType = schemas.LEDGER) -> DataFrame:
    """A trade CSV; an absent file is an empty ledger."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return typed_ledger(spark.read.csv(path, header=True, escape='"'), schema)


def typed_calibration(df: DataFrame, sigma_column: str = "error_robust_sigma_f") -> DataFrame:
    required = {"station", "month", "local_hour", "rows", "error_mean_f", sigma_column}
    missing = required - set(df.columns)
    if missing:
        raise ValueError(f"calibration columns missing: {sorted(missing)}")
    number = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    sigma = F.coalesce(number(sigma_column), F.lit(0.0))
    sigma = F.when(sigma <= 0, F.coalesce(number("error_std_f"), F.lit(0.0))).otherwise(sigma)
    return df.select(
        F.upper("station").alias("station"),
        number("month").cast("int").alias("month"),
        number("local_hour").cast("int").alias("local_hour"),
        number("rows").alias("rows"),
        number("error_mean_f").alias("error_mean_f"),
        F.coalesce(number("error_median_f"), number("error_mean_f")).alias("error_median_f"),
        F.coalesce(number("error_std_f"), sigma).alias("error_std_f"),
        sigma.alias("error_sigma_f"),
        *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("mae_f", "median_abs_error_f", "within_1f_pct", "within_2f_pct")],
    )


def scan_calibration(spark: SparkSession, path: str, sigma_column: str = "error_robust_sigma_f") -> DataFrame:
    return typed_calibration(spark.read.csv(path, header=True), sigma_column)


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: columns missing: {missing}")
    return df


def scan_predictions(spark: SparkSession, path: str, hours: Sequence[int] | None = None) -> DataFrame:
    """Predictions with the needed columns; an hour filter that leaves nothing is an error."""
    raw = require_columns(spark.read.csv(path, header=True), schemas.PREDICTION_REQUIRED, path)
    numeric = [c for c in raw.columns if c not in ("station", "valid", "metar")]
    df = raw.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    if hours is not None:
        df = df.filter(F.col("local_hour").isin(list(hours)))
        if df.isEmpty():
            raise ValueError("no prediction left after the hour filter")
    return df


# --- JSON payloads ---------------------------------------------------------------------------------------
def parse_observation_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Historical-feed payloads to points; broken text gives no rows."""
    doc = F.from_json(F.col(payload), schemas.OBSERVATION_PAYLOAD)
    items = F.coalesce(F.when(F.size(doc["observations"]) > 0, doc["observations"]), doc["observation"])
    rows = df.select(*[c for c in df.columns if c != payload], F.explode(items).alias("o"))
    temp = F.coalesce(F.col("o.temp"), F.col("o.temperature"))
    return rows.select(
        *[c for c in df.columns if c != payload],
        first_utc(F.col("o.valid_time_gmt"), F.col("o.expire_time_gmt"), F.col("o.obsTime")).alias("valid_utc"),
        temp.alias("temp"),
    ).filter("temp IS NOT NULL AND valid_utc IS NOT NULL")


def parse_report_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Lists of report rows; automatic reports are dropped."""
    rows = df.select(*[c for c in df.columns if c != payload],
                     F.explode(F.from_json(F.col(payload), schemas.REPORT_PAYLOAD)).alias("o"))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    raw = F.coalesce(blank(F.col("o.rawOb")), blank(F.col("o.raw")), blank(F.col("o.metar")))
    out = rows.select(
        *[c for c in df.columns if c != payload],
        first_utc(F.col("o.obsTime"), F.col("o.reportTime"), F.col("o.receiptTime")).alias("valid_utc"),
        raw.alias("metar"),
        F.col("o.temp").alias("temp_c"),
    )
    return out.filter(F.col("metar").isNotNull() & F.col("valid_utc").isNotNull()).filter(~M.is_auto(F.col("metar")))


def parse_pushed_records(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Pushed station records: a ``value`` list, a bare list or one object; field aliases; °F out."""
    text = F.trim(F.col(payload))
    as_list = F.from_json(text, T.ArrayType(schemas.PUSHED_RECORD))
    doc = F.from_json(text, T.StructType([T.StructField("value", T.StringType())]))
    inner = F.trim(doc["value"])
    from_value = F.when(inner.startswith("["), F.from_json(inner, T.ArrayType(schemas.PUSHED_RECORD))).otherwise(
        F.array(F.from_json(inner, schemas.PUSHED_RECORD))
    )
    records = F.when(text.startswith("["), as_list).when(inner.isNotNull(), from_value).otherwise(
        F.array(F.from_json(text, schemas.PUSHED_RECORD))
    )
    rest = [c for c in df.columns if c != payload]
    rows = df.select(*rest, F.explode(records).alias("o"))
    field = lambda n: F.trim(F.col("o").getItem(n))
    some = lambda *names: F.coalesce(*[F.when(field(n) != "", field(n)) for n in names])
    temp_text = F.coalesce(field("Temperature"), field("temperature"))
    unit = F.coalesce(some("TemperatureUnit", "temperatureUnit", "TempUnit", "tempUnit", "Unit", "unit"), F.lit(""))
    words = F.upper(F.concat_ws(" ", unit, temp_text))
    source = F.when(words.contains("CELSIUS") | words.rlike(r"°?C\b"), "C").otherwise("F")
    number = F.regexp_extract(temp_text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    out = rows.select(
        *rest,
        F.upper(some("StationCode", "stationCode", "station")).alias("station"),
        first_utc(some("TimeStamp", "timestamp", "time")).alias("valid_utc"),
        F.when(source == "C", number * 9.0 / 5.0 + 32.0).otherwise(number).alias("temp_f"),
        source.alias("source_unit"),
    )
    return out.filter("station IS NOT NULL AND valid_utc IS NOT NULL AND temp_f IS NOT NULL")


def parse_station_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Two-line station files: time line, report line. No temperature, no row."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rest = [c for c in df.columns if c != text]
    out = df.select(
        *rest,
        report_time(F.get(lines, F.lit(0)), "y/M/d H:m").alias("valid_utc"),
        F.get(lines, F.lit(1)).alias("raw_ob"),
    ).withColumn("temp_c", M.strict_temperature(F.col("raw_ob")))
    return out.filter("valid_utc IS NOT NULL AND temp_c IS NOT NULL")


def parse_events(df: DataFrame, payload: str = "payload", page: str = "page") -> DataFrame:
    """Event pages to (event, market) rows; for one event id the later page wins.

    Events with neither id nor slug are each kept, told apart by their place.
    """
    events = df.select(F.col(page).alias("_page"), F.posexplode(F.from_json(F.col(payload), schemas.EVENT_PAGE)).alias("_pos", "e"))
    events = events.withColumn("event_id", F.coalesce(F.col("e.id"), F.col("e.slug"), F.lit("")))
    place = F.when(F.col("event_id") == "", F.struct("_page", "_pos"))
    latest = events.groupBy("event_id", place.alias("_place")).agg(F.max_by("e", F.struct("_page", "_pos")).alias("e"))
    rows = latest.select("event_id", "e.title", "e.slug", F.explode("e.markets").alias("m"))
    from skytally.functions.market import jsonish_list

    names, prices, tokens = [jsonish_list(F.col(f"m.{c}")) for c in ("outcomes", "outcomePrices", "clobTokenIds")]
    yes = pick_by_outcome(names, prices, "Yes").try_cast("double")
    no = pick_by_outcome(names, prices, "No").try_cast("double")
    return rows.select(
        "event_id", "title", "slug",
        F.coalesce(F.col("m.id"), F.col("m.slug"), F.lit("")).alias("market_id"),
        F.col("m.conditionId").alias("condition_id"),
        F.coalesce(F.col("m.question"), F.col("m.title"), F.col("title")).alias("question"),
        yes.alias("yes_price"),
        F.coalesce(no, F.when(yes.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - yes)))).alias("no_price"),
        pick_by_outcome(names, tokens, "Yes").alias("yes_asset"),
        pick_by_outcome(names, tokens, "No").alias("no_asset"),
        F.coalesce(F.lower(F.trim(F.col("m.closed"))).isin("1", "true", "yes"), F.lit(False)).alias("closed"),
    )


def scan_capture(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Capture envelopes, batch or stream; the raw payload stays text."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.CAPTURE).json(path)


def scan_logs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Plain or gzip log lines; bytes that are not UTF-8 come out as replacement characters."""
    return spark.read.text(path)
