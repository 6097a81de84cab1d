"""Trade ledgers: performance, positions, settlement, fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skytally.functions.fees import taker_fee
from skytally.operators.scale import earliest_by, running

CLOSED = ("SETTLED", "SOLD")
ACTIVE = ("OPEN", "BUY_PENDING", "SELL_PENDING")
HELD = (*ACTIVE, "HEDGED")

side_of = lambda c="position_side": F.upper(F.coalesce(F.col(c), F.lit("YES")))


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * 100.0, 4), F.lit(0.0))


def performance(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One report row per group: closed counts SETTLED and SOLD; cost is over all trades, payout and P&L
    over closed ones."""
    closed = F.col("status").isin(*CLOSED)
    pnl = F.coalesce(F.sum(F.when(closed, F.col("pnl_usdc"))), F.lit(0.0))
    closed_cost = F.coalesce(F.sum(F.when(closed, F.col("total_cost_usdc"))), F.lit(0.0))
    wins, n = F.count_if(closed & (F.col("pnl_usdc") > 0)), F.count_if(closed)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), n.alias("closed_trades"), wins.alias("wins"),
        _pct(wins, n).alias("win_rate_pct"),
        F.round(F.sum("total_cost_usdc"), 8).alias("total_cost_usdc"),
        F.round(F.coalesce(F.sum(F.when(closed, F.col("payout_usdc"))), F.lit(0.0)), 8).alias("total_payout_usdc"),
        F.round(pnl, 8).alias("total_pnl_usdc"),
        _pct(pnl, closed_cost).alias("roi_pct_on_closed_cost"),
    )


def event_results(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Money and counts per event (or any grouping), the input of the portfolio reports."""
    closed = F.col("status").isin(*CLOSED)
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    return trades.groupBy(*keys).agg(
        total(closed, "pnl_usdc").alias("realized_pnl_usdc"), total(closed, "total_cost_usdc").alias("settled_cost_usdc"),
        F.sum("total_cost_usdc").alias("total_cost_usdc"), total(~closed, "total_cost_usdc").alias("open_cost_usdc"),
        F.sum("fees_usdc").alias("total_fees_usdc"), total(closed, "payout_usdc").alias("total_payout_usdc"),
        F.count("*").alias("trade_count"), F.count_if(closed).alias("settled_count"), F.count_if(~closed).alias("open_count"),
        F.count_if(closed & (F.col("pnl_usdc") > 0)).alias("win_count"), F.count_if(closed & (F.col("pnl_usdc") <= 0)).alias("loss_count"),
    )


MONEY = "realized_pnl_usdc settled_cost_usdc total_cost_usdc open_cost_usdc".split()
COUNTS = "trade_count settled_count win_count loss_count".split()


def pnl_by_kind(events: DataFrame) -> DataFrame:
    """Sums per kind with ROI on settled cost; zero cost gives null."""
    out = events.groupBy("kind").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in MONEY + COUNTS])
    return out.withColumn("roi_on_settled_cost", F.try_divide("realized_pnl_usdc", "settled_cost_usdc"))


def portfolio(events: DataFrame, key: Sequence[str] = ("event_date", "city", "kind")) -> DataFrame:
    """Grand totals with win rate, ROI and the best and worst event, in one pass."""
    name = F.concat_ws("|", *key)
    sums = [F.sum(c).alias(c) for c in MONEY + ["total_fees_usdc", "total_payout_usdc"] + COUNTS + ["open_count"]]
    out = events.agg(
        *sums,
        F.max_by(name, F.struct("realized_pnl_usdc", name)).alias("best_event"),
        F.min_by(name, F.struct("realized_pnl_usdc", name)).alias("worst_event"),
    )
    return out.withColumn("win_rate", F.try_divide("win_count", "settled_count")).withColumn(
        "roi_on_settled_cost", F.try_divide("realized_pnl_usdc", "settled_cost_usdc")
    )


def value_counts(trades: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Counts per value, null included; with a limit the most frequent ones."""
    counts = trades.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(limit) if limit else counts


def cumulative_by_cycle(cycles: DataFrame, value: str = "realized_pnl_usdc") -> DataFrame:
    """Running P&L over ordered cycles; a null cycle stays null and does not reset the sum."""
    blocked = cycles.withColumn("_year", F.substring("cycle_id", 1, 4))
    out = running(blocked, [], ["_year"], ["cycle_id"], {"_cum": ("sum", F.col(value))})
    return out.withColumn("cum_realized_pnl_usdc", F.when(F.col(value).isNotNull(), F.col("_cum"))).drop("_cum", "_year")


def market_lookup(positions: DataFrame, markets: DataFrame, position_id: str = "position_id") -> DataFrame:
    """Market of each position by asset, then market id, then condition id (case-blind).

    All three keys go through one join: each position offers its non-blank keys, each market its own, and the
    hit with the best priority wins. Blank keys never reach the shuffle, so they cannot form a hot group.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    offer = lambda *pairs: F.filter(
        F.array(*[F.struct(F.lit(p).alias("p"), F.concat(F.lit(t), c).alias("k"), c.alias("raw")) for p, t, c in pairs]),
        lambda s: s["raw"] != "",
    )
    wanted = positions.select(
        position_id, F.explode(offer((0, "a:", text("asset_id")), (1, "m:", text("market_ref")), (2, "c:", F.lower(text("condition_ref"))))).alias("w")
    ).select(position_id, "w.p", "w.k")
    known = markets.select(
        F.col("market_id"),
        F.explode(offer((0, "a:", text("yes_asset")), (0, "a:", text("no_asset")), (1, "m:", text("market_id")), (2, "c:", F.lower(text("condition_id"))))).alias("w"),
    ).select("market_id", "w.k")
    hits = wanted.join(known, "k").groupBy(position_id).agg(F.min_by("market_id", F.struct("p", "market_id")).alias("market_id"))
    return positions.join(hits, position_id)


def new_positions(found: DataFrame, trades: DataFrame, position_id: str = "position_id") -> DataFrame:
    """Positions not yet in the ledger: no open trade with the same (asset, market, side), nor one with a
    blank asset for that market and side; one row per key within the batch."""
    first = earliest_by(found.withColumn("asset_id", F.coalesce("asset_id", F.lit(""))),
                        ["asset_id", "market_id", "side"], [F.col(position_id)], [position_id])
    open_keys = trades.filter("status = 'OPEN'").select(
        F.coalesce("asset_id", F.lit("")).alias("asset_id"), "market_id", side_of().alias("side")
    )
    rest = first.join(open_keys.distinct(), ["asset_id", "market_id", "side"], "left_anti")
    blanks = open_keys.filter("asset_id = ''").select("market_id", "side").distinct()
    return rest.join(blanks, ["market_id", "side"], "left_anti")


def settle(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Open trades of closed markets with a YES/NO outcome, with payout and P&L."""
    outcome = F.initcap(F.trim("outcome"))
    done = markets.filter(F.col("closed") & outcome.isin("Yes", "No")).select("market_id", outcome.alias("winning_outcome"))
    out = trades.filter("status = 'OPEN'").join(done, "market_id")
    payout = F.round(F.when(F.upper("winning_outcome") == side_of(), F.col("shares")).otherwise(0.0), 8)
    out = out.withColumns({"status": F.lit("SETTLED"), "payout_usdc": payout})
    return out.withColumn("pnl_usdc", F.round(F.col("payout_usdc") - F.col("total_cost_usdc"), 8))


def station_mismatches(events: DataFrame, configured: DataFrame, sources: DataFrame) -> DataFrame:
    """First checkable event per (date, city) whose settlement station differs from the configured one.
    Events without a known source station are skipped."""
    rows = events.join(configured, "city").join(sources, "event_id").filter("source_station <> ''")
    first = earliest_by(rows, ["event_date", "city"], [F.col("event_id")], ["event_id", "configured_station", "source_station"])
    return first.filter("source_station <> configured_station")


def replace_reports(history: DataFrame, newest: DataFrame) -> DataFrame:
    """Newest report per station supersedes rows with its time or its text. The two equalities are two
    anti-joins, so both are hash joins."""
    n = newest.select("station", "valid_utc", "metar")
    kept = history.join(n.select("station", "valid_utc"), ["station", "valid_utc"], "left_anti")
    text = n.filter(F.trim("metar") != "").select("station", F.trim("metar").alias("_m"))
    kept = kept.withColumn("_m", F.trim("metar")).join(text, ["station", "_m"], "left_anti").drop("_m")
    return kept.unionByName(newest.select(*kept.columns))


def merge_assets(current: DataFrame, updates: DataFrame, scope: DataFrame) -> DataFrame:
    """Replace market assets of refreshed (city, kind, event) scopes; a re-listed asset keeps its last price."""
    keys = ["city", "kind", "event_id"]
    market_rows = current.filter("role = 'temperature_market'").join(scope.select(*keys).distinct(), keys, "left_anti")
    other = current.filter("role <> 'temperature_market'")
    kept = market_rows.unionByName(other).join(updates.select("asset_id"), "asset_id", "left_anti")
    alive = other.unionByName(market_rows).select("asset_id", F.col("last_price").alias("_old"))
    fresh = updates.join(alive, "asset_id", "left").withColumn("last_price", F.coalesce("last_price", "_old")).drop("_old")
    return kept.unionByName(fresh.select(*kept.columns))


def asset_universe(held: DataFrame, markets: DataFrame) -> DataFrame:
    """Held tokens first, then YES/NO tokens of reachable markets; a held token is never replaced."""
    listed = markets.select("market_id", F.explode(F.array(
        F.struct(F.col("yes_asset").alias("asset_id"), F.lit("YES").alias("side")),
        F.struct(F.col("no_asset").alias("asset_id"), F.lit("NO").alias("side")))).alias("t")).select("market_id", "t.*")
    rows = held.select("asset_id", "market_id", "side", F.lit("held_position").alias("role"), F.lit(0).alias("p")).unionByName(
        listed.select("asset_id", "market_id", "side", F.lit("temperature_market").alias("role"), F.lit(1).alias("p")))
    return earliest_by(rows.filter("asset_id <> ''"), ["asset_id"], [F.col("p"), F.col("market_id"), F.col("side")], ["market_id", "side", "role"])


def held_entry_price(trades: DataFrame, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Share-weighted entry price of held YES legs; price, or cost per share where no price is known."""
    shares = F.col("shares")
    price = F.when(F.coalesce("yes_price", F.lit(0.0)) > 0, F.col("yes_price")).otherwise(F.coalesce(F.try_divide("total_cost_usdc", shares), F.lit(0.0)))
    held = trades.filter((side_of() == "YES") & (shares > 0) & F.col("status").isin(*HELD))
    return held.groupBy(*keys).agg(F.sum("shares").alias("shares"), F.try_divide(F.sum(shares * price), F.sum(shares)).alias("avg_price"))


def active_positions(trades: DataFrame) -> DataFrame:
    return trades.filter(F.col("status").isin(*HELD))


# Valuations --------------------------------------------------------------------------------------------------
def with_entry_value(df: DataFrame, price: str, notional: float, rate: float, shares_override: str | None = None) -> DataFrame:
    p = F.col(price)
    given = F.col(shares_override) if shares_override else F.lit(None).cast("double")
    shares = F.coalesce(given, F.when(p > 0, F.try_divide(F.lit(float(notional)), p)).otherwise(0.0))
    money = F.when(given.isNotNull(), given * p).otherwise(F.lit(float(notional)))
    out = df.withColumn("entry_shares", shares).withColumn("entry_notional", money)
    out = out.withColumn("entry_fee", taker_fee(F.col("entry_shares"), p, rate))
    return out.withColumn("entry_total_cost", F.round(F.col("entry_notional") + F.col("entry_fee"), 8))


def with_exit_value(df: DataFrame, sell: str, yes_ask: str, rate: float, side: str = "position_side") -> DataFrame:
    """Sell the held side, or lock a NO by buying the complementary YES when 1 - ask beats the sell price."""
    s, ask = F.coalesce(F.col(sell), F.lit(0.0)), F.coalesce(F.col(yes_ask), F.lit(0.0))
    is_no = side_of(side) == "NO"
    hedge = is_no & (ask > 0) & (1.0 - ask > s)
    action = F.when(hedge, "buy_yes_hedge").when(s <= 0, "no_sell_price").when(is_no, "sell_no").otherwise("sell_yes")
    shares, cost = F.col("shares"), F.col("total_cost_usdc")
    sell_fee, hedge_fee = taker_fee(shares, s, rate), taker_fee(shares, ask, rate)
    pnl = F.when(hedge, shares - cost - (shares * ask + hedge_fee)).when(s > 0, shares * s - sell_fee - cost)
    return df.select(
        "*", action.alias("exit_action"),
        F.when(hedge, "HEDGED").when(s > 0, "SOLD").otherwise(F.col("status")).alias("exit_status"),
        F.when(hedge, hedge_fee).when(s > 0, sell_fee).alias("exit_fee"),
        F.round(F.when(hedge, shares).when(s > 0, shares * s - sell_fee), 8).alias("exit_payout"),
        F.round(pnl, 8).alias("exit_pnl"),
    )


def with_partial_sale(df: DataFrame, sold: str, price: str, rate: float) -> DataFrame:
    """Cost is apportioned by sold over original shares; under one share left closes the trade."""
    q, p, cost = F.col(sold), F.col(price), F.col("total_cost_usdc")
    left = F.greatest(F.lit(0.0), F.col("shares") - q)
    proceeds = q * p - taker_fee(q, p, rate)
    closes = left < 1
    part = F.coalesce(F.try_divide(q, q + left), F.lit(0.0))
    return df.select(
        "*", F.round(proceeds, 8).alias("sale_proceeds"), F.when(closes, "SOLD").otherwise("OPEN").alias("sale_status"),
        F.when(closes, F.round(proceeds - cost, 8)).alias("sale_pnl"),
        F.when(closes, 0.0).otherwise(left).alias("left_shares"),
        F.when(closes, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), cost - cost * part), 8)).alias("left_cost"),
    )


def with_clamped_fill(df: DataFrame, shares: str, amount: str, price: str, target: str) -> DataFrame:
    """Reported fill clamped to the order's target; amount beyond max(0.01, price) over value is clamped too."""
    p, t = F.col(price), F.col(target)
    q = F.greatest(F.lit(0.0), F.col(shares))
    q = F.when((t > 0) & (q > t), t).otherwise(q)
    a = F.col(amount)
    a = F.when((p > 0) & (a > q * p + F.greatest(F.lit(0.01), p)), q * p).otherwise(a)
    left = F.when(t > 0, F.greatest(F.lit(0.0), t - q)).otherwise(0.0)
    return df.select("*", q.alias("fill_shares"), a.alias("fill_amount"), left.alias("fill_remaining"),
                     F.when(left < 1, "FILLED").otherwise("PARTIAL").alias("fill_status"))


def fill_increments(reports: DataFrame, run: int = 1_000_000) -> DataFrame:
    """Cumulative fill reports to increments over the highest report before; never negative, repeats give 0.

    An order's reports are cut into runs by report number, so one order with very many reports is spread.
    """
    cut = reports.withColumn("_run", F.floor(F.col("report_no") / run).cast("long"))
    out = running(cut, ["order_id"], ["_run"], ["report_no"],
                  {"_s": ("max", F.col("cum_shares"), True), "_c": ("max", F.col("cum_cents"), True)})
    up = lambda now, was: F.greatest(F.lit(0), F.col(now) - F.coalesce(F.col(was), F.lit(0)))
    return out.select(
        *reports.columns, up("cum_shares", "_s").alias("delta_shares"), up("cum_cents", "_c").alias("delta_cents"),
        ((F.col("cum_shares") <= F.coalesce("_s", F.lit(0.0)) + 1e-9) & (F.col("cum_cents") <= F.coalesce("_c", F.lit(0)))).alias("is_repeat"),
    )


def trading_summary(trades: DataFrame, when: str, value: str = "pnl_usdc", width: str = "1 hour") -> DataFrame:
    """Trades, wins, losses, profit, best and worst per clock-aligned window."""
    v = F.col(value)
    out = trades.groupBy(F.window(when, width).alias("w")).agg(
        F.count("*").alias("trades"), F.count_if(v > 0).alias("wins"), F.count_if(v <= 0).alias("losses"),
        F.sum(v).alias("profit"), F.max(v).alias("best"), F.min(v).alias("worst"),
    )
    return out.select(F.col("w.start").alias("window_start"), "trades", "wins", "losses", "profit", "best", "worst")
