"""JSON payloads, feed messages, capture files, lenient scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally import schemas
from skytally.functions import messages as MS
from skytally.functions import scalars as S
from skytally.functions.timeparse import flexible_utc
from skytally.functions.units import tidy
from skytally.plans.registry import query, r
from skytally.sources import readers as R

_SEC = "make_timestamp(epoch * 1000000)"


@query(
    "src7_observation_payloads", "obs",
    f"SELECT seq, {_SEC} AS valid_utc, {r('k / 10.0e0')} AS temp FROM obs WHERE seq % 9 <> 4 AND seq % 31 <> 7",
)
def src7(v):
    s = F.col("seq")
    temp = F.format_string('"%s":%s', F.when(s % 2 == 0, "temp").otherwise("temperature"), F.when(s % 9 == 4, "null").otherwise((F.col("k") / 10.0).cast("string")))
    time = F.when(s % 3 == 0, F.format_string('"valid_time_gmt":%d', "epoch")).when(s % 3 == 1, F.format_string('"valid_time_gmt":0,"expire_time_gmt":%d', "epoch")).otherwise(
        F.format_string('"obsTime":"%s"', F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    doc = F.when(s % 31 == 7, '{"observations":[').otherwise(F.format_string('{"%s":[{%s,%s}]}', F.when(s % 4 == 0, "observation").otherwise("observations"), temp, time))
    return R.parse_observation_payloads(v.obs.select("seq", doc.alias("payload"))).withColumn("temp", tidy(F.col("temp")))


@query("src8_report_payloads", "metar", f"SELECT seq, {_SEC} AS valid_utc, metar, {r('seq % 300 / 10.0e0')} AS temp_c FROM metar WHERE NOT contains(' ' || metar || ' ', ' AUTO ')")
def src8(v):
    s = F.col("seq")
    name = F.when(s % 3 == 0, "rawOb").when(s % 3 == 1, "raw").otherwise("metar")
    time = F.when(s % 2 == 0, F.format_string('"obsTime":%d', "epoch")).otherwise(F.format_string('"obsTime":"","reportTime":"%s"', F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")))
    doc = F.format_string('[{"%s":"%s",%s,"temp":%s}]', name, "metar", time, (s % 300 / 10.0).cast("string"))
    return R.parse_report_payloads(v.metar.select("seq", doc.alias("payload"))).withColumn("temp_c", tidy(F.col("temp_c")))


@query(
    "src9_event_pages", "markets",
    f"SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(market_id AS VARCHAR) AS market_id, concat('p', CAST(event_id % 2 AS VARCHAR)) AS title, {r('coalesce(yes_price, 0.5)')} AS yes_price, {r('CASE WHEN market_id % 3 = 0 THEN 1 - coalesce(yes_price, 0.5) ELSE 0.125e0 END')} AS no_price, yes_asset, closed FROM markets WHERE event_id % 2 = 0 OR market_id % 10 < 5",
)
def src9(v):
    # Every event is on page 0; odd events come again on page 1 with fewer markets and another title.
    m = v.markets
    outcomes = F.when(F.col("market_id") % 3 == 0, '["Yes"]').otherwise('["Yes","No"]')
    item = F.to_json(F.struct(
        F.col("market_id").cast("string").alias("id"), F.lit("q").alias("question"), outcomes.alias("outcomes"),
        F.format_string('["%s","0.125"]', F.coalesce("yes_price", F.lit(0.5)).cast("string")).alias("outcomePrices"),
        F.format_string('["%s","%s"]', "yes_asset", "no_asset").alias("clobTokenIds"), F.col("closed").cast("string").alias("closed")))
    def page(rows, n):
        docs = rows.groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("ms"))
        return docs.select(F.format_string('[{"id":"%d","title":"p%d","markets":[%s]}]', "event_id", F.lit(n), "ms").alias("payload"), F.lit(n).alias("page"))
    pages = page(m, 0).unionByName(page(m.filter("event_id % 2 = 1 AND market_id % 10 < 5"), 1))
    out = R.parse_events(pages)
    return out.select("event_id", "market_id", "title", tidy(F.col("yes_price")).alias("yes_price"), tidy(F.col("no_price")).alias("no_price"), "yes_asset", "closed")


@query("src10_capture_payload_prices", "ticks", "SELECT seq, asset, 'last_price' AS field, price FROM ticks WHERE seq % 6 <> 5")
def src10(v):
    s = F.col("seq")
    doc = F.to_json(F.struct(
        F.when(s % 6 == 5, "recv_error").otherwise("websocket_raw").alias("event_type"), (F.col("us") / 1000).cast("long").alias("received_ms"),
        F.format_string('{"event_type":"last_trade_price","asset_id":"%s","price":"%s"}', "asset", F.col("price").cast("string")).alias("raw")))
    envelopes = v.ticks.select("seq", F.from_json(doc, schemas.CAPTURE).alias("e")).select("seq", "e.*").filter("event_type = 'websocket_raw'")
    return MS.price_rows(envelopes.select("seq", F.col("raw").alias("message")))


_RA = "CASE WHEN seq % 5 = 0 THEN 'best_ask'"


@query(
    "par12_message_prices", "ticks",
    """, s AS (SELECT *, CAST(seq % 6 AS INT) AS h FROM ticks WHERE seq % 23 <> 1)
    SELECT seq, asset, 'last_price' AS field, price FROM s WHERE h IN (0, 4)
    UNION ALL SELECT seq, asset, 'best_bid', price FROM s WHERE h IN (1, 2, 3) UNION ALL SELECT seq, asset, 'best_ask', """ + r("price + 0.01") + """ FROM s WHERE h IN (1, 2, 3)
    UNION ALL SELECT seq, concat(asset, 'x'), 'best_ask', """ + r("price + 0.5") + " FROM s WHERE h = 3",
)
def par12(v):
    h = F.col("seq") % 6
    p, ask = F.col("price").cast("string"), F.round(F.col("price") + 0.01, 6).cast("string")
    f = F.format_string
    doc = (
        F.when(F.col("seq") % 23 == 1, "not json {")
        .when(h == 0, f('{"event_type":"last_trade_price","asset_id":"%s","price":"%s"}', "asset", p))
        .when(h == 1, f('[{"event_type":"book","token_id":"%s","bids":[{"price":"0.0","size":"1"},{"price":"%s"}],"asks":[{"price":"%s"},{"price":"9"}]}]', "asset", p, ask))
        .when(h == 2, f('{"event_type":"best_bid_ask","assetId":"%s","best_bid":%s,"best_ask":"%s","price":"0.7"}', "asset", p, ask))
        .when(h == 3, f('{"event_type":"price_change","price_changes":[{"asset_id":"%s","price":"0.3","best_bid":"%s","best_ask":%s},{"asset_id":"%sx","best_bid":"","best_ask":%s}]}', "asset", p, ask, "asset", F.round(F.col("price") + 0.5, 6).cast("string")))
        .when(h == 4, f('{"data":{"inner":[{"asset":"%s","last_price":%s}]}}', "asset", p))
        .otherwise(f('{"event_type":"book","asset_id":"%s","bids":[],"asks":null}', "asset"))
    )
    return MS.price_rows(v.ticks.select("seq", doc.alias("message"))).withColumn("price", tidy(F.col("price")))


@query(
    "par12_deep_message_prices", "ticks",
    "SELECT seq, asset, 'last_price' AS field, price FROM ticks WHERE seq % 2 = 0 OR seq % 500 IN (17, 19) UNION ALL SELECT seq, concat(asset, 'd'), 'best_bid', price FROM ticks WHERE seq % 500 = 19",
)
def par12_deep(v):
    """Every other message is empty or 7 or 9 levels deep; a few are 501 or 502 deep, the latter with prices on two levels."""
    price, asset = F.col("price").cast("string"), F.col("asset")
    deep = lambda levels, inner: F.concat(F.lit('{"a":[' * (levels // 2)), inner, F.lit("]}" * (levels // 2)))
    one = F.format_string('{"asset":"%s","last_price":%s}', asset, price)
    two = F.concat(F.format_string('{"asset":"%sd","best_bid":%s,"b":', asset, price), deep(500, one), F.lit("}"))
    doc = F.when(F.col("seq") % 500 == 17, deep(500, one)).when(F.col("seq") % 500 == 19, two).when(F.col("seq") % 4 == 0, deep(6, one)).when(F.col("seq") % 4 == 2, deep(8, one)).otherwise('{"a":[]}')
    out = MS.price_rows(v.ticks.select("seq", doc.alias("message")))
    return out.withColumn("price", tidy(F.col("price")))


@query(
    "mkt14_fill_messages", "ticks",
    "SELECT seq, concat('o', asset) AS order_id, qty AS shares, price, 'order' AS role FROM ticks WHERE seq % 3 = 0 UNION ALL SELECT seq, concat('t', asset), qty, price, 'taker' FROM ticks WHERE seq % 3 = 1"
    " UNION ALL SELECT seq, concat('m', asset), 0.5e0, 0.25e0, 'maker' FROM ticks WHERE seq % 3 = 1 UNION ALL SELECT seq, 'm2', qty, price, 'maker' FROM ticks WHERE seq % 3 = 1",
)
def mkt14(v):
    f, p, q = F.format_string, F.col("price").cast("string"), F.col("qty").cast("string")
    doc = F.when(F.col("seq") % 3 == 0, f('{"type":"UPDATE","id":"o%s","size_matched":"%s","price":"%s"}', "asset", q, p)).when(
        F.col("seq") % 3 == 1, f('{"event_type":"trade","taker_order_id":"t%s","size":"%s","price":"%s","maker_orders":[{"order_id":"m%s","matched_amount":"0.5","price":"0.25"},{"order_id":"m2","matched_amount":"%s"}]}', "asset", q, p, "asset", q)
    ).otherwise('{"event_type":"other","id":"z"}')
    return MS.fill_rows(v.ticks.select("seq", doc.alias("message")))


@query(
    "par9_flexible_time", "ticks",
    "SELECT seq, CASE seq % 6 WHEN 0 THEN make_timestamp(epoch * 1000000) WHEN 1 THEN make_timestamp(CAST(floor(us / 1000) AS BIGINT) * 1000) WHEN 2 THEN make_timestamp(epoch * 1000000) WHEN 3 THEN make_timestamp(epoch * 1000000) WHEN 4 THEN make_timestamp((epoch - 7200) * 1000000) END AS t FROM ticks",
)
def par9(v):
    s, e = F.col("seq") % 6, F.timestamp_seconds("epoch")
    text = (
        F.when(s == 0, F.col("epoch").cast("string")).when(s == 1, F.floor(F.col("us") / 1000).cast("string")).when(s == 2, F.date_format(e, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(s == 3, F.date_format(e, "yyyy-MM-dd HH:mm:ss")).when(s == 4, F.date_format(e, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise("soon")
    )
    return v.ticks.select("seq", flexible_utc(text).alias("t"))


@query(
    "par10_pushed_records", "obs",
    f"SELECT seq, upper(station) AS station, {_SEC} AS valid_utc, {r('CASE WHEN seq % 2 = 0 THEN (k / 10.0e0) * 9.0e0 / 5.0e0 + 32.0e0 ELSE k / 10.0e0 END')} AS temp_f, CASE WHEN seq % 2 = 0 THEN 'C' ELSE 'F' END AS source_unit FROM obs WHERE seq % 8 <> 3",
)
def par10(v):
    s, f, t = F.col("seq"), F.format_string, (F.col("k") / 10.0).cast("string")
    st = F.lower("station")
    a = f('{"StationCode":"%s","TimeStamp":%d,"Temperature":"%s","Unit":"Celsius"}', st, F.col("epoch") * 1000, t)
    b = f('{"station":" %s ","time":"%s","temperature":"%s°F"}', st, F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), t)
    c = f('{"stationCode":"%s","timestamp":%d,"temperature":"%s °C"}', st, "epoch", t)
    d = f('{"station":"%s","timestamp":%d,"Temperature":%s}', st, "epoch", t)
    one = F.when(s % 4 == 0, a).when(s % 4 == 1, b).when(s % 4 == 2, c).otherwise(d)
    doc = F.when(s % 8 == 3, f('{"station":"%s","timestamp":%d,"temperature":"none"}', st, "epoch")).when(s % 3 == 0, F.concat(F.lit('{"value":['), one, F.lit("]}"))).when(s % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    return R.parse_pushed_records(v.obs.select("seq", doc.alias("payload"))).withColumn("temp_f", tidy(F.col("temp_f")))


@query(
    "par11_lenient_scalars", "events",
    "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS number, event_id % 5 = 3 AS flag, CASE WHEN event_id % 5 IN (0, 1, 2) THEN -1 ELSE value END AS safe FROM events",
)
def par11(v):
    m = F.col("event_id") % 5
    text = F.when(m == 0, "NaN").when(m == 1, "Infinity").when(m == 2, " abc").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    flag = F.when(m == 3, " Yes").when(m == 4, "0").otherwise("no")
    return v.events.select("event_id", S.finite_double(text).alias("number"), S.truthy(flag).alias("flag"), S.double_or(text, -1.0).alias("safe"))


@query("src12_typed_predictions", "predictions", f"SELECT station, {r('actual_high_f')} AS actual_high_f, {r('error_f')} AS error_f FROM predictions WHERE seq % 3 = 1")
def src12(v):
    raw = v.predictions.filter("seq % 3 = 1").withColumns({"local_hour": F.lit("1"), "predicted_high_f": F.col("actual_high_f") + F.col("error_f"), "abs_error_f": F.abs("error_f")})
    checked = R.require_columns(raw, schemas.PREDICTION_REQUIRED, "predictions")
    return checked.select("station", tidy(F.col("actual_high_f")).alias("actual_high_f"), tidy(F.col("error_f")).alias("error_f"))


@query("src12_typed_predictions_whole", "predictions", f"SELECT seq, station, {r('actual_high_f')} AS actual_high_f, {r('error_f')} AS error_f FROM predictions")
def src12_whole(v):
    raw = v.predictions.withColumns({"local_hour": F.lit("1"), "predicted_high_f": F.col("actual_high_f") + F.col("error_f"), "abs_error_f": F.abs("error_f")})
    checked = R.require_columns(raw, schemas.PREDICTION_REQUIRED, "predictions")
    return checked.select("seq", "station", tidy(F.col("actual_high_f")).alias("actual_high_f"), tidy(F.col("error_f")).alias("error_f"))
