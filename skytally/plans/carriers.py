"""Deterministic weather and market views of the given tables.

The given tables hold no weather or market rows. Each view here is one or more SELECT steps over one
table, written once in the SQL both engines share; ``frame`` runs it on Spark and ``ctes`` renders it for
the checking engine. ``EPOCH(x)`` and ``MICROS(x)`` are the only words that are spelled differently.

Row counts and key counts of every view grow with the table under it; density per key (reports per station,
markets per event, levels per token) stays the same.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skytally.session import prepare

_INT = "CAST(floor({0}) AS BIGINT)"


def _i(expr: str) -> str:
    return _INT.format(expr)


# name -> (source table or view, [(column, expression), ...], filter or None)
VIEWS: dict[str, tuple[str, list[tuple[str, str]], str | None]] = {}

# --- observations -------------------------------------------------------------------------------------
VIEWS["obs_raw"] = (
    "events",
    [
        ("seq", "event_id"),
        ("ts", "ts"),
        ("g", _i("user_id / 10")),
        ("k", _i("value * 100 + 0.5")),
        ("m", "CASE WHEN event_id % 10 < 7 THEN 53 ELSE CAST(extract(MINUTE FROM ts) AS INT) END"),
    ],
    None,
)
VIEWS["obs"] = (
    "obs_raw",
    [
        ("station", "concat('K', CAST(g + 100 AS STRING))"),
        (
            "tz",
            "CASE g % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'"
            " WHEN 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END",
        ),
        ("seq", "seq"),
        ("k", "k"),
        ("valid_utc", "date_trunc('HOUR', ts) + INTERVAL '1' MINUTE * m"),
        ("epoch", "EPOCH(date_trunc('HOUR', ts)) + m * 60"),
        ("utc_minute", "m"),
        ("tenths", "CASE WHEN seq % 11 = 3 THEN NULL ELSE k % 400 - 50 END"),
        ("dew_tenths", "CASE WHEN seq % 11 = 3 THEN NULL ELSE k % 400 - 80 - k % 50 END"),
        ("cor", "seq % 37 = 0"),
        ("auto", "seq % 13 = 5"),
    ],
    None,
)
_SGN = "CASE WHEN {0} < 0 THEN 'M' ELSE '' END, lpad(CAST(" + _i("abs({0}) / 10") + " AS STRING), 2, '0')"
_TG = "CASE WHEN {0} < 0 THEN '1' ELSE '0' END, lpad(CAST(abs({0}) AS STRING), 3, '0')"
_WINDDIR = "lpad(CAST((k % 36 + 1) * 10 AS STRING), 3, '0')"
VIEWS["metar"] = (
    "obs",
    [
        ("station", "station"),
        ("tz", "tz"),
        ("seq", "seq"),
        ("valid_utc", "valid_utc"),
        ("epoch", "epoch"),
        ("utc_minute", "utc_minute"),
        (
            "metar",
            "concat(station, ' ', lpad(CAST(extract(DAY FROM valid_utc) AS STRING), 2, '0'),"
            " lpad(CAST(extract(HOUR FROM valid_utc) AS STRING), 2, '0'), lpad(CAST(utc_minute AS STRING), 2, '0'), 'Z',"
            " CASE WHEN auto THEN ' AUTO' ELSE '' END, CASE WHEN cor THEN ' COR' ELSE '' END,"
            " CASE WHEN seq % 17 = 0 THEN ' VRB04KT' WHEN seq % 19 = 0 THEN ' 00000KT' WHEN seq % 23 = 0 THEN ''"
            f" WHEN seq % 5 = 0 THEN concat(' ', {_WINDDIR}, lpad(CAST(k % 25 + 3 AS STRING), 2, '0'), 'G', lpad(CAST(k % 25 + 13 AS STRING), 2, '0'), 'KT')"
            f" ELSE concat(' ', {_WINDDIR}, lpad(CAST(k % 25 + 3 AS STRING), 2, '0'), 'KT') END,"
            " CASE seq % 6 WHEN 0 THEN ' 10SM' WHEN 1 THEN ' 1 1/2SM' WHEN 2 THEN ' 3/4SM' WHEN 3 THEN ' M1/4SM' WHEN 4 THEN ' 7SM' ELSE '' END,"
            " CASE seq % 7 WHEN 0 THEN ' -RA BR' WHEN 1 THEN ' +TSRA' WHEN 2 THEN ' HZ' WHEN 3 THEN ' -SN FG' ELSE '' END,"
            " CASE seq % 8 WHEN 0 THEN ' CLR' WHEN 1 THEN ' FEW025 SCT040' WHEN 2 THEN ' BKN008 OVC015' WHEN 3 THEN ' SCT///'"
            " WHEN 4 THEN ' VV002' WHEN 5 THEN ' OVC100' WHEN 6 THEN ' FEW010 BKN050CB' ELSE '' END,"
            f" CASE WHEN seq % 9 = 4 THEN '' WHEN tenths IS NULL THEN ' ////' ELSE concat(' ', {_SGN.format('tenths')}, '/', {_SGN.format('dew_tenths')}) END,"
            " ' A', CAST(2950 + k % 100 AS STRING),"
            " CASE WHEN seq % 10 = 9 THEN '' ELSE concat(' RMK AO2',"
            " CASE WHEN seq % 4 = 1 THEN '' ELSE concat(' SLP', lpad(CAST(k % 1000 AS STRING), 3, '0')) END,"
            " CASE WHEN seq % 7 = 0 THEN concat(' P', lpad(CAST(k % 60 AS STRING), 4, '0')) ELSE '' END,"
            f" CASE WHEN tenths IS NULL OR seq % 12 = 7 THEN '' ELSE concat(' T', {_TG.format('tenths')}, {_TG.format('dew_tenths')}) END,"
            " CASE WHEN seq % 3 = 0 THEN concat(' 5', CAST(k % 9 AS STRING), lpad(CAST(k % 100 AS STRING), 3, '0')) ELSE '' END) END)",
        ),
    ],
    None,
)
# Whole reports as lines of an archive file, with blank, comment, header and bad-time lines among them.
VIEWS["archive_lines"] = (
    "metar",
    [
        ("seq", "seq"),
        (
            "value",
            "CASE WHEN seq % 101 = 7 THEN '' WHEN seq % 101 = 8 THEN '# comment' WHEN seq % 101 = 9 THEN 'station,valid,metar'"
            " WHEN seq % 101 = 10 THEN concat(station, ',2024-13-45 99:99,', metar)"
            " ELSE concat(substr(station, 2), ',', CAST(extract(YEAR FROM valid_utc) AS STRING), '-',"
            " CAST(extract(MONTH FROM valid_utc) AS STRING), '-', CAST(extract(DAY FROM valid_utc) AS STRING), ' ',"
            " CAST(extract(HOUR FROM valid_utc) AS STRING), ':', CAST(utc_minute AS STRING), ',', metar,"
            " CASE WHEN seq % 5 = 1 THEN ', NOSPECI' ELSE '' END) END",
        ),
    ],
    None,
)
# --- two feeds -----------------------------------------------------------------------------------------
VIEWS["feed_a"] = (
    "obs",
    [("station", "station"), ("tz", "tz"), ("seq", "seq"), ("valid_utc", "valid_utc"), ("epoch", "epoch"),
     ("utc_minute", "utc_minute"), ("cor", "cor"), ("temp_c", "tenths / 10.0e0"),
     ("temp_f", _i("tenths / 10.0e0 * 9.0e0 / 5.0e0 + 32.0e0 + 0.5e0"))],
    "tenths IS NOT NULL",
)
VIEWS["feed_b"] = (
    "feed_a",
    [("station", "station"), ("tz", "tz"), ("seq", "seq"),
     ("valid_utc", "CASE WHEN seq % 29 = 4 THEN valid_utc + INTERVAL '1' MINUTE ELSE valid_utc END"),
     ("epoch", "CASE WHEN seq % 29 = 4 THEN epoch + 60 ELSE epoch END"),
     ("temp_f", "CASE WHEN seq % 11 = 1 THEN temp_f + 1 ELSE temp_f END")],
    "seq % 7 <> 2",
)
# --- predictions ----------------------------------------------------------------------------------------
VIEWS["predictions"] = (
    "obs",
    [("station", "station"), ("tz", "tz"), ("seq", "seq"), ("valid_utc", "valid_utc"), ("epoch", "epoch"),
     ("utc_minute", "utc_minute"),
     ("actual_high_f", "tenths / 10.0e0 * 9.0e0 / 5.0e0 + 40.0e0"),
     ("error_f", "(k * 7 % 1301 - 640) / 97.0e0 * CASE WHEN seq % 3 = 0 THEN 1.0e0 ELSE 0.25e0 END"),
     ("error_c", "(k * 7 % 301 - 150) / 193.0e0")],
    "tenths IS NOT NULL",
)
# --- ledger ---------------------------------------------------------------------------------------------
VIEWS["ledger"] = (
    "orders",
    [
        ("trade_id", "o_orderkey"),
        ("cycle_id", "concat(CAST(extract(YEAR FROM o_orderdate) AS STRING), '-', lpad(CAST(extract(MONTH FROM o_orderdate) AS STRING), 2, '0'))"),
        ("event_date", "concat(CAST(extract(YEAR FROM o_orderdate) AS STRING), '-', lpad(CAST(extract(MONTH FROM o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(extract(DAY FROM o_orderdate) AS STRING), 2, '0'))"),
        ("opened_at", "o_orderdate"),
        ("city", "concat('City', CAST(o_custkey % 97 AS STRING))"),
        ("kind", "CASE WHEN o_orderkey % 3 = 0 THEN 'Lowest' ELSE 'Highest' END"),
        ("strategy", "CASE WHEN o_orderkey % 2 = 0 THEN 'model' ELSE 'harvest' END"),
        ("market_id", "o_custkey"),
        ("position_side", "CASE o_orderkey % 4 WHEN 0 THEN 'NO' WHEN 1 THEN NULL ELSE 'YES' END"),
        ("status", "CASE o_orderstatus WHEN 'F' THEN 'SETTLED' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'BUY_PENDING' ELSE 'OPEN' END"
                   " ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'HEDGED' ELSE 'SOLD' END END"),
        ("exit_reason", "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat(lower(substr(o_orderpriority, 3)), CAST(o_orderkey % 4 AS STRING)) END"),
        ("cents", _i("o_totalprice * 100 + 0.5")),
        ("price", "(5 + o_orderkey % 90) / 100.0e0"),
    ],
    None,
)
VIEWS["trades"] = (
    "ledger",
    [("trade_id", "trade_id"), ("cycle_id", "cycle_id"), ("event_date", "event_date"), ("opened_at", "opened_at"),
     ("city", "city"), ("kind", "kind"), ("strategy", "strategy"), ("market_id", "market_id"),
     ("position_side", "position_side"), ("status", "status"), ("exit_reason", "exit_reason"),
     ("yes_price", "CASE WHEN trade_id % 9 = 0 THEN NULL ELSE price END"),
     ("shares", "CAST(1 + cents % 40 AS DOUBLE)"),
     ("total_cost_usdc", "(1 + cents % 40) * price"),
     ("fees_usdc", "(cents % 17) / 100.0e0"),
     ("payout_usdc", "CASE WHEN status IN ('SETTLED','SOLD') AND cents % 2 = 0 THEN CAST(1 + cents % 40 AS DOUBLE) ELSE 0.0e0 END"),
     ("pnl_usdc", "CASE WHEN status IN ('SETTLED','SOLD') THEN CASE WHEN cents % 2 = 0 THEN CAST(1 + cents % 40 AS DOUBLE) ELSE 0.0e0 END - (1 + cents % 40) * price ELSE 0.0e0 END")],
    None,
)
# --- interval markets: ten per event, two degrees wide, both ends open, some Celsius ------------------------
VIEWS["market_raw"] = (
    "part",
    [("e", _i("p_partkey / 10")), ("j", "p_partkey % 10"), ("p_partkey", "p_partkey"), ("p_size", "p_size"),
     ("cents", _i("p_retailprice * 100 + 0.5"))],
    None,
)
_C = "e % 5 = 4"
_LO_F = "(60 + e % 13 + 2 * j)"
_LO_C = "(12 + e % 11 + 2 * j)"
_LO = f"CASE WHEN {_C} THEN {_LO_C} ELSE {_LO_F} END"
VIEWS["markets"] = (
    "market_raw",
    [
        ("event_id", "e"),
        ("market_id", "p_partkey"),
        ("kind", "CASE WHEN e % 3 = 2 THEN 'Lowest' ELSE 'Highest' END"),
        ("city", "concat('City', CAST(e % 97 AS STRING))"),
        ("unit", f"CASE WHEN {_C} THEN 'C' ELSE 'F' END"),
        ("rule_min", f"CASE WHEN j = 0 THEN NULL ELSE CAST({_LO} AS DOUBLE) END"),
        ("rule_max", f"CASE WHEN j = 9 THEN NULL ELSE CAST({_LO} + CASE WHEN p_partkey % 31 = 3 THEN 2 ELSE 1 END AS DOUBLE) END"),
        ("closed", "p_size % 13 = 0"),
        ("yes_price", "CASE WHEN cents % 19 = 0 THEN NULL ELSE (1 + cents % 98) / 100.0e0 END"),
        ("yes_asset", "concat('y', CAST(p_partkey AS STRING))"),
        ("no_asset", "concat('n', CAST(p_partkey AS STRING))"),
        ("condition_id", "concat('0xC', CAST(p_partkey AS STRING))"),
        ("outcome", "CASE WHEN p_size % 13 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'maybe' ELSE '' END ELSE '' END"),
    ],
    None,
)
# Question texts of the same markets, in the wordings the parser must read.
VIEWS["questions"] = (
    "markets",
    [
        ("market_id", "market_id"),
        ("event_id", "event_id"),
        (
            "question",
            "CASE WHEN rule_min IS NULL THEN concat('Will the temperature be ', CAST(CAST(rule_max AS BIGINT) AS STRING), CASE WHEN unit = 'C' THEN '°C' ELSE '°F' END, ' or below?')"
            " WHEN rule_max IS NULL THEN concat('Will it be ', CAST(CAST(rule_min AS BIGINT) AS STRING), ' degrees ', CASE WHEN unit = 'C' THEN 'Celsius' ELSE 'Fahrenheit' END, ' or higher?')"
            " WHEN market_id % 4 = 0 THEN concat('Between ', CAST(CAST(rule_min AS BIGINT) AS STRING), ' and ', CAST(CAST(rule_max AS BIGINT) AS STRING), ' deg ', unit)"
            " WHEN market_id % 4 = 1 THEN concat(CAST(CAST(rule_min AS BIGINT) AS STRING), '–', CAST(CAST(rule_max AS BIGINT) AS STRING), '°', unit, '?')"
            " WHEN market_id % 4 = 2 THEN concat('exactly ', CAST(CAST(rule_min AS BIGINT) AS STRING), '.5°', lower(unit))"
            " WHEN market_id % 28 = 3 THEN 'No number here'"
            " ELSE concat(CAST(CAST(rule_min AS BIGINT) AS STRING), '-', CAST(CAST(rule_max AS BIGINT) AS STRING), ' fahrenheit') END",
        ),
        ("title", "concat(CASE WHEN market_id % 2 = 0 THEN 'highest' ELSE 'Lowest' END, ' temperature in ', city, ' on ',"
                  " CASE event_id % 4 WHEN 0 THEN 'January 5' WHEN 1 THEN 'June 18' WHEN 2 THEN 'December 31' ELSE 'nonsense' END, CASE WHEN market_id % 3 = 0 THEN '?' ELSE '' END)"),
        ("today", "CASE WHEN event_id % 2 = 0 THEN DATE '2024-12-20' ELSE DATE '2024-03-01' END"),
    ],
    None,
)
# Observed extremes per event, in the event's unit.
VIEWS["extremes"] = (
    "market_raw",
    [("event_id", "e"),
     ("observed_high", f"CASE WHEN e % 7 = 0 THEN NULL ELSE CAST({_LO} + (cents + 7 * e) % 26 - 3 AS DOUBLE) END"),
     ("observed_low", f"CASE WHEN e % 9 = 1 THEN NULL ELSE CAST({_LO} + (cents + 5 * e) % 24 - 2 AS DOUBLE) END")],
    "j = 0",
)
# One prediction per order, in Fahrenheit tenths, spread over the events; value is in the event's unit.
VIEWS["pred_raw"] = (
    "orders",
    [("pred_id", "o_orderkey"), ("cents", _i("o_totalprice * 100 + 0.5")), ("event_id", _i("o_custkey / 8"))],
    None,
)
VIEWS["preds"] = (
    "pred_raw",
    [("pred_id", "pred_id"), ("event_id", "event_id"), ("cents", "cents"),
     ("unit", "CASE WHEN event_id % 5 = 4 THEN 'C' ELSE 'F' END"),
     ("predicted_f", "(550 + cents % 420) / 10.0e0"),
     ("value", "CASE WHEN event_id % 5 = 4 THEN ((550 + cents % 420) / 10.0e0 - 32.0e0) * 5.0e0 / 9.0e0 ELSE (550 + cents % 420) / 10.0e0 END"),
     ("station", "concat('s', CAST(pred_id % 30 AS STRING))"),
     ("month", "CAST(1 AS INT)"), ("local_hour", "CAST(pred_id % 2 AS INT)")],
    None,
)
VIEWS["calib"] = (
    "nation",
    [("station", "concat('S', CAST(n_nationkey AS STRING))"), ("month", "CAST(1 AS INT)"), ("local_hour", "CAST(n_nationkey % 2 AS INT)"),
     ("error_mean_f", "(n_nationkey % 5 - 2) / 3.0e0"), ("error_sigma_f", "CASE WHEN n_nationkey % 6 = 0 THEN 0.0e0 ELSE 1.0e0 + n_nationkey % 4 / 3.0e0 END")],
    None,
)
# Another venue's markets on the same events.
VIEWS["venue"] = (
    "markets",
    [("event_id", "event_id"), ("ticker", "concat('T', CAST(market_id AS STRING))"),
     ("floor_strike", "CASE WHEN market_id % 14 = 5 THEN NULL ELSE rule_min + event_id % 3 - 1 END"),
     ("cap_strike", "rule_max + event_id % 3 - 1"),
     ("yes_bid", "CASE WHEN market_id % 6 = 0 THEN 0.0e0 ELSE (market_id * 37 % 89) / 100.0e0 END"),
     ("yes_ask", "CASE WHEN market_id % 8 = 0 THEN NULL ELSE (market_id * 37 % 89 + 3) / 100.0e0 END"),
     ("last_price", "CASE WHEN market_id % 3 = 0 THEN NULL ELSE (market_id * 53 % 97) / 100.0e0 END")],
    "event_id % 6 <> 5",
)
# --- order books ----------------------------------------------------------------------------------------
VIEWS["levels"] = (
    "lineitem",
    [
        ("market_id", "l_partkey"),
        ("token", "CASE WHEN l_linenumber % 2 = 0 THEN 'YES' ELSE 'NO' END"),
        ("side", "CASE WHEN l_returnflag = 'A' THEN 'bid' ELSE 'ask' END"),
        ("price", "CASE WHEN l_quantity = 50 THEN 0.0e0 ELSE (5 + (" + _i("l_extendedprice * 100 + 0.5") + " + l_orderkey) % CASE WHEN l_returnflag = 'A' THEN 45 ELSE 90 END) / 100.0e0 END"),
        ("size", "l_quantity"),
    ],
    None,
)
# --- fills: cumulative reports per order, with repeats -----------------------------------------------------
VIEWS["fill_reports"] = (
    "lineitem",
    [
        ("order_id", "l_orderkey"),
        ("report_no", "l_linenumber * 1000000 + l_partkey"),
        ("price", "(10 + l_orderkey % 80) / 100.0e0"),
        ("cum_shares", "CAST(l_linenumber * 10 + CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_partkey % 7 END AS DOUBLE)"),
        ("cum_cents", "(l_linenumber * 10 + CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_partkey % 7 END) * (10 + l_orderkey % 80)"),
        ("target", "CAST(20 + l_orderkey % 50 AS DOUBLE)"),
    ],
    None,
)
# --- ticks ----------------------------------------------------------------------------------------------
VIEWS["ticks"] = (
    "events",
    [
        ("seq", "event_id"),
        ("ts", "ts"),
        ("epoch", "EPOCH(ts)"),
        ("us", "MICROS(ts)"),
        ("asset", "concat('a', CAST(" + _i("user_id / 10") + " AS STRING))"),
        ("field", "CASE event_type WHEN 'click' THEN 'best_bid' WHEN 'view' THEN 'best_ask' ELSE 'last_price' END"),
        ("price", "(" + _i("value * 100 + 0.5") + " % 99) / 100.0e0"),
        ("qty", _i("value * 100 + 0.5") + " % 53 / 10.0e0"),
        ("buyer_maker", "event_id % 2 = 0"),
    ],
    None,
)
# --- forecast snapshots ---------------------------------------------------------------------------------
_DIG = _i("o_totalprice * 100 + 0.5")
VIEWS["snapshots"] = (
    "orders",
    [
        ("snap_id", "o_orderkey"),
        ("city", "concat('City', CAST(" + _i("o_custkey / 15") + " AS STRING))"),
        ("kind", "CASE WHEN o_orderkey % 2 = 0 THEN 'Highest' ELSE 'Lowest' END"),
        ("cycle_id", "o_orderkey % 1000"),
        ("observed_at", "o_orderdate"),
        ("observed_epoch", "EPOCH(o_orderdate)"),
        *[(f"forecast_p{i:02d}", f"CASE WHEN (o_orderkey + {i}) % 7 = 0 THEN NULL ELSE (300 + ({_DIG} * {i * 7 + 3}) % 500) / 10.0e0 END") for i in range(1, 7)],
        *[(f"observed_h{i:02d}", f"CASE WHEN (o_orderkey + {i}) % 3 = 0 THEN NULL ELSE (300 + ({_DIG} * {i * 11 + 1}) % 500) / 10.0e0 END") for i in range(1, 4)],
    ],
    None,
)
# The same snapshots as JSON payloads of parallel arrays; every 41st is broken text.
VIEWS["payload_text"] = (
    "snapshots",
    [
        ("snap_id", "snap_id"),
        ("city", "city"),
        ("target_date", "'2024-06-0' || CAST(1 + snap_id % 3 AS STRING)"),
        (
            "payload",
            "CASE WHEN snap_id % 41 = 0 THEN '{broken' ELSE concat('{\"validTimeLocal\":[\"2024-06-01T22:00:00\",\"2024-06-02T00:00:00\",\"2024-06-03T01:00:00\"],\"temperature\":[',"
            " CAST(30 + snap_id % 50 AS STRING), ',', CASE WHEN snap_id % 6 = 0 THEN 'null' ELSE CAST(30 + snap_id * 7 % 50 AS STRING) END,"
            " CASE WHEN snap_id % 5 = 0 THEN '' ELSE concat(',', CAST(30 + snap_id * 3 % 50 AS STRING)) END,"
            " '],\"relativeHumidity\":[', CAST(snap_id % 100 AS STRING), ']}') END",
        ),
    ],
    None,
)
# --- logs -----------------------------------------------------------------------------------------------
VIEWS["log_lines"] = (
    "documents",
    [
        ("line_id", "doc_id"),
        (
            "value",
            "concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), ' ', lpad(CAST(doc_id * 7 % 24 AS STRING), 2, '0'), ':',"
            " lpad(CAST(doc_id * 11 % 60 AS STRING), 2, '0'), ':', lpad(CAST(doc_id * 13 % 60 AS STRING), 2, '0'), ' INFO ',"
            " CASE doc_id % 6 WHEN 0 THEN 'prediction ' WHEN 1 THEN 'Traceback ' WHEN 2 THEN 'order ' WHEN 3 THEN 'ORDER filled ' ELSE '' END,"
            " CASE doc_id % 5 WHEN 0 THEN 'kaus ' WHEN 1 THEN 'KDEN ' ELSE '' END, replace(replace(text, chr(10), ' '), chr(13), ' '))",
        ),
    ],
    None,
)

_SPARK_WORDS = [(r"EPOCH\(", "unix_seconds("), (r"MICROS\(", "unix_micros(")]
_DUCK_WORDS = [(r"EPOCH\(", "epoch_seconds("), (r"MICROS\(", "epoch_us(")]


def _render(text: str, duck: bool) -> str:
    for word, to in _DUCK_WORDS if duck else _SPARK_WORDS:
        text = re.sub(rf"\b{word}", to, text)
    if duck:
        text = re.sub(r"epoch_seconds\(((?:[^()]|\([^()]*\))*)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)
        text = re.sub(r"extract\((\w+) FROM", lambda m: f"extract({m.group(1).lower()} FROM", text)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps are UTC instants."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
    return df


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    source, columns, where = VIEWS[name]
    df = frame(spark, sf_dir, source)
    if where:
        df = df.filter(_render(where, False))
    made_once = TEXTS.get(name)
    out = df.selectExpr(*[f"{'array' if c == made_once else ''}({_render(e, False)}) AS {c}" for c, e in columns])
    # A filter on a long text expression would be pushed below it and build the text twice; a one-element
    # explode keeps it where it is, as a scan column would be.
    return out.withColumn(made_once, F.explode(made_once)) if made_once else out


# Views whose long text column is built once per row.
TEXTS = {"metar": "metar", "archive_lines": "value", "payload_text": "payload", "log_lines": "value", "questions": "question"}


def _needed(names) -> list[str]:
    out: list[str] = []

    def visit(name):
        if name in VIEWS and name not in out:
            visit(VIEWS[name][0])
            out.append(name)

    for n in names:
        visit(n)
    return out


def ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views and the views under them."""
    parts = []
    for name in _needed(names):
        source, columns, where = VIEWS[name]
        cols = ", ".join(f"{_render(e, True)} AS {c}" for c, e in columns)
        parts.append(f"{name} AS (SELECT {cols} FROM {source}" + (f" WHERE {_render(where, True)}" if where else "") + ")")
    return "WITH " + ",\n".join(parts) if parts else ""
