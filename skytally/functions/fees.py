"""Fees, edges, profit tiers and order sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (highest buy price, profit wanted) per tier.
PROFIT_TIERS = [
    (0.10, 4.50), (0.15, 3.50), (0.20, 2.00), (0.25, 1.40), (0.30, 0.95), (0.35, 0.60),
    (0.40, 0.40), (0.45, 0.23), (0.50, 0.13), (0.55, 0.10), (0.75, 0.08),
]


def taker_fee(shares: Column, price: Column, rate: float) -> Column:
    return F.round(rate * shares * price * (1.0 - price), 8)


def edge_after_fee(fair: Column, price: Column, rate: float) -> Column:
    return fair - price - taker_fee(F.lit(1.0), price, rate)


def short_window_fee(price: Column, rate: float) -> Column:
    """Per share; price clamped to [0.01, 0.99], not rounded."""
    p = F.when(price.isNotNull(), F.least(F.lit(0.99), F.greatest(F.lit(0.01), price)))
    return max(0.0, rate) * p * (1.0 - p)


def expected_profit(buy: Column, sell: Column, rate: float) -> Column:
    cost = buy + short_window_fee(buy, rate)
    revenue = F.when(sell.isNotNull(), F.greatest(F.lit(0.0), sell - short_window_fee(sell, rate)))
    return F.when(cost.isNull() | revenue.isNull(), F.lit(None).cast("double")).when(cost > 0, F.try_divide(revenue - cost, cost)).otherwise(F.lit(0.0))


def required_profit(price: Column, tiers=PROFIT_TIERS) -> Column:
    """Profit of the first tier reaching the price; null above the last tier or at a price of zero.

    The tier list is configuration of fixed length, so it is a literal ``when`` chain and needs no join.
    """
    chain = F.when(price <= 0, F.lit(None).cast("double"))
    for upper, profit in sorted(tiers):
        chain = chain.when(price <= upper + 1e-9, F.lit(profit))
    return chain


def with_order_size(df: DataFrame, price: str, budget: str, minimum: str | None = None) -> DataFrame:
    """Whole shares and clean spend, in cents; ``below_minimum`` when a minimum column is given."""
    p, b = F.col(price), F.col(budget)
    cents = F.bround(p * 100, 0).cast("long")
    budget_cents = F.floor(b * 100).cast("long")
    shares = F.when((p > 0) & (b > 0) & (cents > 0), F.floor(budget_cents / F.nullif(cents, F.lit(0)))).otherwise(0)
    out = df.withColumn("order_shares", shares.cast("double"))
    out = out.withColumn("order_spend", F.col("order_shares") * cents / 100.0)
    if minimum:
        out = out.withColumn("below_minimum", F.col("order_shares") + 1e-9 < F.col(minimum))
    return out
