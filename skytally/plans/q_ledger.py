"""Ledger performance, settlement, positions, fills and valuations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally import schemas
from skytally.functions.fees import with_order_size
from skytally.functions.units import tidy
from skytally.operators import ledger as L
from skytally.plans.registry import query, r
from skytally.plans.q_reports import _tidy_all

EVENT = ["event_date", "city", "kind"]
CL = "status IN ('SETTLED', 'SOLD')"


def _perf(keys: str) -> str:
    return (
        f"SELECT {keys}, count(*) AS trades, count(*) FILTER (WHERE {CL}) AS closed_trades, count(*) FILTER (WHERE {CL} AND pnl_usdc > 0) AS wins,"
        f" coalesce({r(f'count(*) FILTER (WHERE {CL} AND pnl_usdc > 0) / nullif(count(*) FILTER (WHERE {CL}), 0) * 100', 4)}, 0.0e0) AS win_rate_pct,"
        f" {r('sum(total_cost_usdc)')} AS total_cost_usdc, {r(f'coalesce(sum(payout_usdc) FILTER (WHERE {CL}), 0)')} AS total_payout_usdc, {r(f'coalesce(sum(pnl_usdc) FILTER (WHERE {CL}), 0)')} AS total_pnl_usdc,"
        f" coalesce({r(f'sum(pnl_usdc) FILTER (WHERE {CL}) / nullif(sum(total_cost_usdc) FILTER (WHERE {CL}), 0) * 100', 4)}, 0.0e0) AS roi_pct_on_closed_cost FROM trades GROUP BY {keys}"
    )


@query("agg16_performance_by_cycle", "trades", _perf("cycle_id"))
def agg16(v):
    return _tidy_all(L.performance(v.trades, ["cycle_id"]))


@query("agg16_performance_by_event", "trades", _perf("event_date, city, kind"))
def agg16b(v):
    return _tidy_all(L.performance(v.trades, EVENT))


SQL_EVENTS = (
    f", ev AS (SELECT event_date, city, kind, coalesce(sum(pnl_usdc) FILTER (WHERE {CL}), 0) AS realized_pnl_usdc, coalesce(sum(total_cost_usdc) FILTER (WHERE {CL}), 0) AS settled_cost_usdc, sum(total_cost_usdc) AS total_cost_usdc,"
    f" coalesce(sum(total_cost_usdc) FILTER (WHERE NOT {CL}), 0) AS open_cost_usdc, sum(fees_usdc) AS total_fees_usdc, coalesce(sum(payout_usdc) FILTER (WHERE {CL}), 0) AS total_payout_usdc, count(*) AS trade_count,"
    f" count(*) FILTER (WHERE {CL}) AS settled_count, count(*) FILTER (WHERE NOT {CL}) AS open_count, count(*) FILTER (WHERE {CL} AND pnl_usdc > 0) AS win_count, count(*) FILTER (WHERE {CL} AND pnl_usdc <= 0) AS loss_count FROM trades GROUP BY 1, 2, 3)"
)


@query(
    "agg13_pnl_by_kind", "trades",
    SQL_EVENTS + " SELECT kind, " + ", ".join(f"{r(f'sum({c})', 4)} AS {c}" for c in L.MONEY) + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in L.COUNTS)
    + f", {r('sum(realized_pnl_usdc) / nullif(sum(settled_cost_usdc), 0)')} AS roi_on_settled_cost FROM ev GROUP BY 1",
)
def agg13(v):
    out = L.pnl_by_kind(L.event_results(v.trades, EVENT))
    return out.withColumns({**{c: tidy(F.col(c), 4) for c in L.MONEY}, "roi_on_settled_cost": tidy(F.col("roi_on_settled_cost"))})


@query(
    "agg14_portfolio_totals", "trades",
    SQL_EVENTS + " SELECT " + ", ".join(f"{r(f'sum({c})', 4)} AS {c}" for c in L.MONEY + ["total_fees_usdc", "total_payout_usdc"]) + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in L.COUNTS + ["open_count"])
    + f", {r('sum(win_count) / sum(settled_count)')} AS win_rate, {r('sum(realized_pnl_usdc) / sum(settled_cost_usdc)')} AS roi_on_settled_cost FROM ev",
)
def agg14(v):
    out = L.portfolio(L.event_results(v.trades, EVENT)).drop("best_event", "worst_event")
    money = L.MONEY + ["total_fees_usdc", "total_payout_usdc"]
    return out.withColumns({**{c: tidy(F.col(c), 4) for c in money}, "roi_on_settled_cost": tidy(F.col("roi_on_settled_cost")), "win_rate": tidy(F.col("win_rate"))})


@query(
    "srt5_best_worst_event", "trades",
    f", ev AS (SELECT concat(event_date, '|', city, '|', kind) AS k, {r(f'coalesce(sum(pnl_usdc) FILTER (WHERE {CL}), 0)')} AS p FROM trades GROUP BY 1)"
    " SELECT (SELECT k FROM ev ORDER BY p DESC, k DESC LIMIT 1) AS best_event, (SELECT k FROM ev ORDER BY p, k LIMIT 1) AS worst_event",
)
def srt5(v):
    ev = L.event_results(v.trades, EVENT).withColumn("realized_pnl_usdc", tidy(F.col("realized_pnl_usdc")))
    return L.portfolio(ev).select("best_event", "worst_event")


@query("agg15_status_counts", "trades", "SELECT status, count(*) AS n FROM trades GROUP BY 1")
def agg15(v):
    return L.value_counts(v.trades, "status")


@query("agg15_exit_reasons", "trades", "SELECT exit_reason, count(*) AS n FROM trades GROUP BY 1 ORDER BY n DESC, exit_reason NULLS FIRST LIMIT 12")
def agg15b(v):
    return L.value_counts(v.trades, "exit_reason", 12)


@query(
    "win6_cumulative_pnl", "trades",
    f", c AS (SELECT cycle_id, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE sum(pnl_usdc) END AS p FROM trades GROUP BY 1) SELECT cycle_id, {r('p', 4)} AS realized_pnl_usdc,"
    f" CASE WHEN p IS NOT NULL THEN {r('sum(p) OVER (ORDER BY cycle_id ROWS UNBOUNDED PRECEDING)', 4)} END AS cum_realized_pnl_usdc FROM c",
)
def win6(v):
    cycles = v.trades.groupBy("cycle_id").agg(F.when(F.count("*") % 7 != 0, F.sum("pnl_usdc")).alias("realized_pnl_usdc"))
    out = L.cumulative_by_cycle(cycles)
    return out.withColumns({c: tidy(F.col(c), 4) for c in ("realized_pnl_usdc", "cum_realized_pnl_usdc")})


@query(
    "agg23_trading_summary", "trades",
    f"SELECT date_trunc('day', opened_at) AS window_start, count(*) AS trades, count_if(pnl_usdc > 0) AS wins, count_if(pnl_usdc <= 0) AS losses, {r('sum(pnl_usdc)')} AS profit, {r('max(pnl_usdc)')} AS best, {r('min(pnl_usdc)')} AS worst"
    f" FROM trades WHERE {CL} GROUP BY 1",
)
def agg23(v):
    return _tidy_all(L.trading_summary(v.trades.filter(F.col("status").isin(*L.CLOSED)), "opened_at", width="1 day"))


@query(
    "src5_typed_ledger", "trades",
    "SELECT CAST(trade_id AS VARCHAR) AS trade_id, city, coalesce(position_side, 'YES') AS position_side, yes_price, CASE WHEN trade_id % 13 = 0 THEN 0.0e0 ELSE shares END AS shares, exit_no_price, status FROM (SELECT *, CAST(NULL AS DOUBLE) AS exit_no_price FROM trades)",
)
def src5(v):
    from skytally.sources.readers import typed_ledger

    text = v.trades.select(
        F.col("trade_id").cast("string").alias("﻿trade_id"), "city", "status", F.coalesce("position_side", F.lit("")).alias("position_side"),
        F.coalesce(F.col("yes_price").cast("string"), F.lit("")).alias("yes_price"), F.when(F.col("trade_id") % 13 == 0, "").otherwise(F.col("shares").cast("string")).alias("shares"),
    )
    return typed_ledger(text).select("trade_id", "city", "position_side", "yes_price", "shares", "exit_no_price", "status")


@query("flt7_active_positions", "trades", "SELECT trade_id, status, market_id FROM trades WHERE status IN ('OPEN', 'BUY_PENDING', 'SELL_PENDING', 'HEDGED')")
def flt7(v):
    return L.active_positions(v.trades).select("trade_id", "status", "market_id")


# Positions ---------------------------------------------------------------------------------------------------
SQL_POS = (
    ", pos AS (SELECT trade_id AS position_id, CASE trade_id % 5 WHEN 0 THEN concat('y', CAST(market_id AS VARCHAR)) WHEN 1 THEN concat('n', CAST(market_id AS VARCHAR)) WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'unknown' END AS asset_id,"
    " CASE WHEN trade_id % 7 < 3 THEN CAST(market_id + 3 AS VARCHAR) END AS market_ref, CASE WHEN trade_id % 11 < 6 THEN concat('0XC', CAST(market_id + 5 AS VARCHAR)) ELSE '' END AS condition_ref, coalesce(position_side, 'YES') AS side FROM trades)"
)


def _positions(v):
    return v.trades.selectExpr(
        "trade_id AS position_id",
        "CASE trade_id % 5 WHEN 0 THEN concat('y', market_id) WHEN 1 THEN concat('n', market_id) WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'unknown' END AS asset_id",
        "CASE WHEN trade_id % 7 < 3 THEN CAST(market_id + 3 AS STRING) END AS market_ref",
        "CASE WHEN trade_id % 11 < 6 THEN concat('0XC', market_id + 5) ELSE '' END AS condition_ref",
        "coalesce(position_side, 'YES') AS side",
    )


SQL_FOUND = SQL_POS + (
    ", fnd AS (SELECT p.*, coalesce(a.market_id, b.market_id, m.market_id, c.market_id) AS market_id FROM pos p LEFT JOIN markets a ON p.asset_id = a.yes_asset LEFT JOIN markets b ON p.asset_id = b.no_asset"
    " LEFT JOIN markets m ON p.market_ref = CAST(m.market_id AS VARCHAR) LEFT JOIN markets c ON lower(p.condition_ref) = lower(c.condition_id))"
)


@query("joi17_position_market", "trades markets", SQL_FOUND + " SELECT position_id, market_id, side FROM fnd WHERE market_id IS NOT NULL")
def joi17(v):
    return L.market_lookup(_positions(v), v.markets).select("position_id", "market_id", "side")


@query(
    "joi18_new_positions", "trades markets",
    SQL_FOUND + ", o AS (SELECT CASE WHEN trade_id % 3 = 0 THEN '' ELSE concat('y', CAST(market_id AS VARCHAR)) END AS asset_id, market_id, coalesce(position_side, 'YES') AS side FROM trades WHERE status = 'OPEN'),"
    " f AS (SELECT coalesce(asset_id, '') AS asset_id, market_id, side, min(position_id) AS position_id FROM fnd WHERE market_id IS NOT NULL GROUP BY 1, 2, 3)"
    " SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.market_id = f.market_id AND o.side = f.side AND (o.asset_id = f.asset_id OR o.asset_id = ''))",
)
def joi18(v):
    asset = F.when(F.col("trade_id") % 3 == 0, "").otherwise(F.concat(F.lit("y"), F.col("market_id")))
    return L.new_positions(L.market_lookup(_positions(v), v.markets), v.trades.withColumn("asset_id", asset))


@query(
    "joi19_settlement", "trades markets",
    ", d AS (SELECT market_id, lower(outcome) AS o FROM markets WHERE closed AND lower(outcome) IN ('yes', 'no')) SELECT t.trade_id, t.market_id, 'SETTLED' AS status, upper(o[1]) || o[2:] AS winning_outcome,"
    f" CASE WHEN upper(o) = coalesce(position_side, 'YES') THEN shares ELSE 0.0e0 END AS payout_usdc, {r('CASE WHEN upper(o) = coalesce(position_side, $$YES$$) THEN shares ELSE 0.0e0 END - total_cost_usdc')} AS pnl_usdc FROM trades t JOIN d ON t.market_id = d.market_id WHERE status = 'OPEN'",
)
def joi19(v):
    out = L.settle(v.trades, v.markets)
    return out.select("trade_id", "market_id", "status", "winning_outcome", "payout_usdc", tidy(F.col("pnl_usdc")).alias("pnl_usdc"))


@query(
    "joi20_station_mismatch", "markets",
    ", ev AS (SELECT DISTINCT event_id, city, CAST(event_id % 5 AS BIGINT) AS event_date FROM markets), cf AS (SELECT DISTINCT city, concat('K', right(concat('00', substr(city, 5)), 3)) AS configured_station FROM markets),"
    " so AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 4 = 0 THEN 'KXXX' ELSE concat('K', right(concat('00', substr(city, 5)), 3)) END AS source_station FROM ev),"
    " j AS (SELECT ev.event_date, ev.city, ev.event_id, configured_station, source_station, row_number() OVER (PARTITION BY ev.event_date, ev.city ORDER BY ev.event_id) AS x FROM ev JOIN cf ON ev.city = cf.city JOIN so ON ev.event_id = so.event_id WHERE source_station <> '')"
    " SELECT event_date, city, event_id, configured_station, source_station FROM j WHERE x = 1 AND configured_station <> source_station",
)
def joi20(v):
    station = F.expr("concat('K', right(concat('00', substr(city, 5)), 3))")
    events = v.markets.select("event_id", "city", (F.col("event_id") % 5).alias("event_date")).distinct()
    configured = v.markets.select("city", station.alias("configured_station")).distinct()
    sources = events.select("event_id", F.when(F.col("event_id") % 6 == 0, "").when(F.col("event_id") % 4 == 0, "KXXX").otherwise(station).alias("source_station"))
    return L.station_mismatches(events, configured, sources)


@query(
    "joi21_replace_reports", "metar",
    ", n AS (SELECT station, valid_utc, CASE WHEN seq % 2 = 0 THEN metar ELSE concat(metar, ' X') END AS metar, -seq AS seq FROM metar WHERE seq % 50 = 3)"
    " SELECT station, valid_utc, metar, seq FROM metar m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.station = m.station AND (n.valid_utc = m.valid_utc OR trim(n.metar) = trim(m.metar))) UNION ALL SELECT station, valid_utc, metar, seq FROM n",
)
def joi21(v):
    base = v.metar.select("station", "valid_utc", "metar", "seq")
    newest = base.filter("seq % 50 = 3").withColumns({"metar": F.expr("CASE WHEN seq % 2 = 0 THEN metar ELSE concat(metar, ' X') END"), "seq": -F.col("seq")})
    return L.replace_reports(base, newest)


@query(
    "joi25_asset_merge", "markets",
    ", cur AS (SELECT yes_asset AS asset_id, city, kind, event_id, CASE WHEN market_id % 9 = 0 THEN 'held_position' ELSE 'temperature_market' END AS role, yes_price AS last_price FROM markets WHERE market_id % 4 <> 3),"
    " up AS (SELECT yes_asset AS asset_id, city, kind, event_id, 'temperature_market' AS role, CASE WHEN market_id % 5 = 0 THEN 0.5e0 END AS last_price FROM markets WHERE event_id % 3 = 1),"
    " sc AS (SELECT DISTINCT city, kind, event_id FROM markets WHERE event_id % 3 = 1 AND event_id % 2 = 0), alive AS (SELECT cur.* FROM cur WHERE role <> 'temperature_market' OR (city, kind, event_id) NOT IN (SELECT city, kind, event_id FROM sc))"
    " SELECT * FROM alive WHERE asset_id NOT IN (SELECT asset_id FROM up) UNION ALL SELECT up.asset_id, up.city, up.kind, up.event_id, up.role, coalesce(up.last_price, alive.last_price) FROM up LEFT JOIN alive ON up.asset_id = alive.asset_id",
)
def joi25(v):
    cols = ["asset_id", "city", "kind", "event_id", "role", "last_price"]
    m = v.markets.withColumn("asset_id", F.col("yes_asset"))
    cur = m.filter("market_id % 4 <> 3").withColumn("role", F.when(F.col("market_id") % 9 == 0, "held_position").otherwise("temperature_market")).withColumn("last_price", F.col("yes_price")).select(*cols)
    up = m.filter("event_id % 3 = 1").withColumn("role", F.lit("temperature_market")).withColumn("last_price", F.when(F.col("market_id") % 5 == 0, 0.5)).select(*cols)
    return L.merge_assets(cur, up, m.filter("event_id % 3 = 1 AND event_id % 2 = 0"))


# All markets on both sides and in the scope; marked keys are current assets without an update, new assets and events that are not refreshed.
@query(
    "joi25_asset_merge_whole", "markets",
    ", cur AS (SELECT CASE WHEN market_id % 4 = 3 THEN concat('C', yes_asset) ELSE yes_asset END AS asset_id, city, kind, event_id, CASE WHEN market_id % 9 = 0 THEN 'held_position' ELSE 'temperature_market' END AS role, yes_price AS last_price FROM markets),"
    " up AS (SELECT CASE WHEN event_id % 3 = 1 THEN yes_asset ELSE concat('U', yes_asset) END AS asset_id, city, kind, event_id, 'temperature_market' AS role, CASE WHEN market_id % 5 = 0 THEN 0.5e0 END AS last_price FROM markets),"
    " sc AS (SELECT DISTINCT city, kind, CASE WHEN event_id % 6 = 4 THEN event_id ELSE -1 - event_id END AS event_id FROM markets), alive AS (SELECT cur.* FROM cur WHERE role <> 'temperature_market' OR (city, kind, event_id) NOT IN (SELECT city, kind, event_id FROM sc))"
    " SELECT * FROM alive WHERE asset_id NOT IN (SELECT asset_id FROM up) UNION ALL SELECT up.asset_id, up.city, up.kind, up.event_id, up.role, coalesce(up.last_price, alive.last_price) FROM up LEFT JOIN alive ON up.asset_id = alive.asset_id",
)
def joi25_whole(v):
    cols = ["asset_id", "city", "kind", "event_id", "role", "last_price"]
    yes, market, event = F.col("yes_asset"), F.col("market_id"), F.col("event_id")
    cur = v.markets.withColumns({"asset_id": F.when(market % 4 == 3, F.concat(F.lit("C"), yes)).otherwise(yes), "role": F.when(market % 9 == 0, "held_position").otherwise("temperature_market"), "last_price": F.col("yes_price")})
    up = v.markets.withColumns({"asset_id": F.when(event % 3 == 1, yes).otherwise(F.concat(F.lit("U"), yes)), "role": F.lit("temperature_market"), "last_price": F.when(market % 5 == 0, 0.5)})
    scope = v.markets.withColumn("event_id", F.when(event % 6 == 4, event).otherwise(-1 - event))
    return L.merge_assets(cur.select(*cols), up.select(*cols), scope)


@query(
    "mkt19_asset_universe", "trades markets",
    ", h AS (SELECT CASE WHEN coalesce(position_side, 'YES') = 'YES' THEN yes_asset ELSE no_asset END AS asset_id, m.market_id, coalesce(position_side, 'YES') AS side FROM trades t JOIN markets m ON t.market_id = m.market_id WHERE status = 'OPEN'),"
    " a AS (SELECT asset_id, market_id, side, 'held_position' AS role, 0 AS p FROM h UNION ALL SELECT yes_asset, market_id, 'YES', 'temperature_market', 1 FROM markets WHERE NOT closed UNION ALL SELECT no_asset, market_id, 'NO', 'temperature_market', 1 FROM markets WHERE NOT closed)"
    " SELECT asset_id, market_id, side, role FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY p, market_id, side) AS x FROM a) WHERE x = 1",
)
def mkt19(v):
    side = F.coalesce("position_side", F.lit("YES"))
    held = v.trades.filter("status = 'OPEN'").join(v.markets.select("market_id", "yes_asset", "no_asset"), "market_id").select(
        F.when(side == "YES", F.col("yes_asset")).otherwise(F.col("no_asset")).alias("asset_id"), "market_id", side.alias("side"))
    return L.asset_universe(held, v.markets.filter("NOT closed"))


@query(
    "agg22_held_entry_price", "trades",
    f"SELECT market_id, sum(shares) AS shares, {r('sum(shares * CASE WHEN yes_price > 0 THEN yes_price ELSE total_cost_usdc / shares END) / sum(shares)', 10)} AS avg_price FROM trades"
    " WHERE status IN ('OPEN', 'BUY_PENDING', 'SELL_PENDING', 'HEDGED') AND coalesce(position_side, 'YES') = 'YES' AND shares > 0 GROUP BY 1",
)
def agg22(v):
    # Ten places: cents over a share count like 160 end in a 5 at the seventh place, where sums in another order would differ.
    return L.held_entry_price(v.trades).withColumn("avg_price", tidy(F.col("avg_price"), 10))


# Valuations and fills ----------------------------------------------------------------------------------------
FEE = "{q} * {p} * (1 - {p}) * 0.05"


@query(
    "mkt10_entry_valuation", "trades",
    ", q AS (SELECT trade_id, coalesce(yes_price, 0) AS p, CASE WHEN trade_id % 2 = 0 THEN shares END AS o FROM trades), z AS (SELECT trade_id, p, coalesce(o, CASE WHEN p > 0 THEN 10 / p ELSE 0 END) AS s, CASE WHEN o IS NOT NULL THEN o * p ELSE 10 END AS n FROM q)"
    f" SELECT trade_id, {r('s')} AS entry_shares, {r('n')} AS entry_notional, {r(FEE.format(q='s', p='p'))} AS entry_fee, {r('n + ' + FEE.format(q='s', p='p'))} AS entry_total_cost FROM z",
)
def mkt10(v):
    df = v.trades.select("trade_id", F.coalesce("yes_price", F.lit(0.0)).alias("p"), F.when(F.col("trade_id") % 2 == 0, F.col("shares")).alias("o"))
    out = L.with_entry_value(df, "p", 10.0, 0.05, "o")
    return out.select("trade_id", *[tidy(F.col(c)).alias(c) for c in ("entry_shares", "entry_notional", "entry_fee", "entry_total_cost")])


@query(
    "mkt11_exit_valuation", "trades",
    ", q AS (SELECT *, CASE WHEN trade_id % 6 = 0 THEN 0.0e0 ELSE (trade_id % 83) / 100.0e0 END AS s, CASE WHEN trade_id % 7 = 0 THEN 0.0e0 ELSE (trade_id % 91) / 100.0e0 END AS a, coalesce(position_side, 'YES') = 'NO' AS no FROM trades), h AS (SELECT *, no AND a > 0 AND 1 - a > s AS hg FROM q)"
    " SELECT trade_id, CASE WHEN hg THEN 'buy_yes_hedge' WHEN s <= 0 THEN 'no_sell_price' WHEN no THEN 'sell_no' ELSE 'sell_yes' END AS exit_action, CASE WHEN hg THEN 'HEDGED' WHEN s > 0 THEN 'SOLD' ELSE status END AS exit_status,"
    f" {r('CASE WHEN hg THEN shares WHEN s > 0 THEN shares * s - ' + FEE.format(q='shares', p='s') + ' END')} AS exit_payout,"
    f" {r('CASE WHEN hg THEN shares - total_cost_usdc - shares * a - ' + FEE.format(q='shares', p='a') + ' WHEN s > 0 THEN shares * s - ' + FEE.format(q='shares', p='s') + ' - total_cost_usdc END')} AS exit_pnl FROM h",
)
def mkt11(v):
    df = v.trades.withColumns({
        "s": F.when(F.col("trade_id") % 6 == 0, 0.0).otherwise((F.col("trade_id") % 83) / 100.0), "a": F.when(F.col("trade_id") % 7 == 0, 0.0).otherwise((F.col("trade_id") % 91) / 100.0)})
    return L.with_exit_value(df, "s", "a", 0.05).select("trade_id", "exit_action", "exit_status", tidy(F.col("exit_payout")).alias("exit_payout"), tidy(F.col("exit_pnl")).alias("exit_pnl"))


@query(
    "mkt12_partial_sale", "trades",
    ", q AS (SELECT *, floor(shares * (1 + trade_id % 4) / 4) AS q, (trade_id % 83) / 100.0e0 AS p FROM trades), z AS (SELECT *, greatest(0, shares - q) AS l FROM q)"
    f" SELECT trade_id, {r('q * p - ' + FEE.format(q='q', p='p'))} AS sale_proceeds, CASE WHEN l < 1 THEN 'SOLD' ELSE 'OPEN' END AS sale_status, {r('CASE WHEN l < 1 THEN q * p - ' + FEE.format(q='q', p='p') + ' - total_cost_usdc END')} AS sale_pnl,"
    f" CASE WHEN l < 1 THEN 0.0e0 ELSE l END AS left_shares, {r('CASE WHEN l < 1 THEN 0 ELSE greatest(0, total_cost_usdc - total_cost_usdc * q / (q + l)) END')} AS left_cost FROM z",
)
def mkt12(v):
    df = v.trades.withColumns({"q": F.floor(F.col("shares") * (1 + F.col("trade_id") % 4) / 4).cast("double"), "p": (F.col("trade_id") % 83) / 100.0})
    out = L.with_partial_sale(df, "q", "p", 0.05)
    return out.select("trade_id", "sale_status", *[tidy(F.col(c)).alias(c) for c in ("sale_proceeds", "sale_pnl", "left_shares", "left_cost")])


@query(
    "mkt13_clamped_fill", "fill_reports",
    ", q AS (SELECT order_id, report_no, price, target, cum_shares, cum_shares * price * CASE WHEN report_no % 3 = 0 THEN 1.4 ELSE 1 END AS am FROM fill_reports), z AS (SELECT *, least(cum_shares, target) AS s FROM q)"
    f" SELECT order_id, report_no, s AS fill_shares, {r('CASE WHEN am > s * price + greatest(0.01, price) THEN s * price ELSE am END')} AS fill_amount, greatest(0, target - s) AS fill_remaining, CASE WHEN target - s < 1 THEN 'FILLED' ELSE 'PARTIAL' END AS fill_status FROM z",
)
def mkt13(v):
    amount = F.col("cum_shares") * F.col("price") * F.when(F.col("report_no") % 3 == 0, 1.4).otherwise(1.0)
    out = L.with_clamped_fill(v.fill_reports.withColumn("am", amount), "cum_shares", "am", "price", "target")
    return out.select("order_id", "report_no", "fill_shares", tidy(F.col("fill_amount")).alias("fill_amount"), "fill_remaining", "fill_status")


@query(
    "win16_fill_increments", "fill_reports",
    ", f AS (SELECT order_id, report_no, max(cum_shares) AS cum_shares, max(cum_cents) AS cum_cents FROM fill_reports GROUP BY 1, 2), p AS (SELECT *, coalesce(max(cum_shares) OVER w, 0) AS ps, coalesce(max(cum_cents) OVER w, 0) AS pc FROM f"
    " WINDOW w AS (PARTITION BY order_id ORDER BY report_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    " SELECT order_id, report_no, greatest(0, cum_shares - ps) AS delta_shares, greatest(0, cum_cents - pc) AS delta_cents, cum_shares <= ps + 1e-9 AND cum_cents <= pc AS is_repeat FROM p",
)
def win16(v):
    reports = v.fill_reports.groupBy("order_id", "report_no").agg(F.max("cum_shares").alias("cum_shares"), F.max("cum_cents").alias("cum_cents"))
    return L.fill_increments(reports).select("order_id", "report_no", "delta_shares", "delta_cents", "is_repeat")


@query(
    "prj11_order_size", "trades",
    ", q AS (SELECT trade_id, (trade_id % 97) / 100.0e0 AS p, (trade_id % 1000) / 8.0e0 AS b FROM trades), z AS (SELECT *, CAST(round_even(p * 100, 0) AS BIGINT) AS c, CAST(floor(b * 100) AS BIGINT) AS bc FROM q), s AS (SELECT *, CASE WHEN p > 0 AND b > 0 AND c > 0 THEN CAST(bc // c AS DOUBLE) ELSE 0.0e0 END AS n FROM z)"
    f" SELECT trade_id, n AS order_shares, {r('n * c / 100.0e0')} AS order_spend, n + 1e-9 < 5 AS below_minimum FROM s",
)
def prj11(v):
    df = v.trades.select("trade_id", ((F.col("trade_id") % 97) / 100.0).alias("p"), ((F.col("trade_id") % 1000) / 8.0).alias("b"), F.lit(5.0).alias("min"))
    return with_order_size(df, "p", "b", "min").select("trade_id", "order_shares", tidy(F.col("order_spend")).alias("order_spend"), "below_minimum")
