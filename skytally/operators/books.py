"""Order-book depth.

Levels are merged per (market, token, side, price) first. Prices lie on a four-decimal grid in (0, 1], so a
book side holds at most ten thousand rows after that, whatever the number of raw levels; ordered work over a
side is bounded by that.

The opposite token's book is the same liquidity seen from the other side: a bid at p on NO is an ask at 1 - p
on YES. Both sources are lined up by relabelling rows, so no join of the two books is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skytally.functions.market import clamp01, opposite

BOOK = ["market_id", "token", "side"]


def merge_levels(levels: DataFrame) -> DataFrame:
    """Drop non-positive levels, add up equal prices (four decimals)."""
    good = levels.filter((F.col("price") > 0) & (F.col("size") > 0))
    return good.groupBy(*BOOK, F.round("price", 4).alias("price")).agg(F.sum("size").alias("size"))


def sorted_book(levels: DataFrame) -> DataFrame:
    """One row per book side with its levels in order: bids from the top, asks from the bottom."""
    merged = merge_levels(levels)
    s = F.when(F.col("side") == "bid", -1.0).otherwise(1.0)
    rows = merged.groupBy(*BOOK).agg(F.sort_array(F.collect_list(F.struct((s * F.col("price")).alias("k"), "price", "size"))).alias("l"))
    return rows.select(*BOOK, F.transform("l", lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))).alias("levels"))


def best_quotes(levels: DataFrame) -> DataFrame:
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    good = levels.filter((F.col("price") > 0) & (F.col("size") > 0))
    return good.groupBy("market_id", "token").agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"))


def buy_levels(levels: DataFrame) -> DataFrame:
    """Levels one can buy a token at: its own asks (direct) and the opposite bids at 1 - p (complement)."""
    merged = merge_levels(levels)
    ask = F.col("side") == "ask"
    out = merged.select(
        "market_id",
        F.when(ask, F.col("token")).otherwise(opposite(F.col("token"))).alias("token"),
        F.when(ask, "direct").otherwise("complement").alias("source"),
        F.when(ask, F.col("price")).otherwise(clamp01(1.0 - F.col("price"))).alias("price"),
        "size",
    )
    return out.filter("price > 0")


def depth_price(rows: DataFrame, keys: list[str], target: float | Column, by: str = "notional", descending: bool = False, extra: int = 0) -> DataFrame:
    """First price whose cumulative depth reaches the target, ``extra`` levels further on if there are any.
    Books that do not reach it give no row."""
    order = F.desc("price") if descending else F.asc("price")
    w = Window.partitionBy(*keys).orderBy(order)
    amount = F.col("price") * F.col("size") if by == "notional" else F.col("size")
    cum = F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*keys)
    end = (F.min if descending else F.max)("price").over(whole)
    priced = F.coalesce(F.lead("price", extra).over(w), end) if extra else F.col("price")
    out = rows.select(*keys, "price", cum.alias("_cum"), priced.alias("_p"))
    t = target if isinstance(target, Column) else F.lit(float(target))
    hit = out.filter(F.col("_cum") >= t)
    pick = F.max_by if descending else F.min_by
    return hit.groupBy(*keys).agg(pick("_p", "price").alias("depth_price"))


def best_buy(levels: DataFrame, target: float, by: str = "notional") -> DataFrame:
    """Cheapest executable price per token over both sources."""
    per = depth_price(buy_levels(levels), ["market_id", "token", "source"], target, by)
    return per.groupBy("market_id", "token").agg(F.min("depth_price").alias("buy_price"))


def best_offer(levels: DataFrame) -> DataFrame:
    """Top-of-book price with the shares there; at equal price the direct book goes first."""
    src = F.when(F.col("source") == "direct", 0).otherwise(1)
    return buy_levels(levels).groupBy("market_id", "token").agg(
        F.min(F.struct("price", src.alias("s"), "size")).alias("o")
    ).select("market_id", "token", F.col("o.price").alias("offer_price"), F.col("o.size").alias("offer_size"))


def best_sell(levels: DataFrame) -> DataFrame:
    """Highest of the own bid and 1 - opposite ask."""
    good = levels.filter((F.col("price") > 0) & (F.col("size") > 0))
    bid = F.col("side") == "bid"
    top = good.groupBy("market_id", "token", "side").agg(F.max("price").alias("hi"), F.min("price").alias("lo"))
    rows = top.select(
        "market_id", F.when(bid, F.col("token")).otherwise(opposite(F.col("token"))).alias("token"),
        F.when(bid, F.col("hi")).otherwise(clamp01(1.0 - F.col("lo"))).alias("p"),
    )
    return rows.groupBy("market_id", "token").agg(F.max("p").alias("sell_price"))


def fillable(levels: DataFrame, target: float, max_price: float) -> DataFrame:
    """Most notional fillable at once under a price cap, in whole shares; the last level is taken in part.
    The better of the two sources wins: more notional, then the lower price, then the direct book."""
    keys = ["market_id", "token", "source"]
    rows = buy_levels(levels).filter(F.col("price") <= max_price)
    w = Window.partitionBy(*keys).orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("price") * F.col("size")).over(w), F.lit(0.0))
    rows = rows.withColumn("_left", target - before).filter("_left > 0")
    take = F.least(F.col("size"), F.col("_left") / F.col("price"))
    per = rows.groupBy(*keys).agg(F.sum(take).alias("shares"), F.max("price").alias("limit"))
    per = per.filter("shares >= 1").withColumn("order_shares", F.floor(F.least(F.col("shares"), target / F.col("limit"))).cast("double"))
    per = per.filter("order_shares >= 1").select(
        "market_id", "token", F.round("limit", 2).alias("price"), "order_shares", F.round(F.col("order_shares") * F.col("limit"), 2).alias("amount_usd"),
        F.when(F.col("source") == "direct", 1).otherwise(0).alias("d"))
    best = F.max_by(F.struct("price", "order_shares", "amount_usd"), F.struct("amount_usd", -F.col("price"), "d"))
    return per.groupBy("market_id", "token").agg(best.alias("b")).select("market_id", "token", "b.*")


def smoothed_exit(smoothed_bid: Column, best_bid: Column, depth_bid: Column) -> Column:
    """Smoothed bid less the gap between the best bid and the depth price, not below a cent."""
    gap = F.when((depth_bid > 0) & (best_bid > 0), F.greatest(F.lit(0.0), best_bid - depth_bid))
    return F.round(F.when(gap.isNotNull(), F.greatest(F.lit(0.01), smoothed_bid - gap)).otherwise(smoothed_bid), 2)
