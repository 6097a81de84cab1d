"""Price ticks: trailing frames, previous prices, window moves, fair values, momentum.

Ticks carry ``asset``, ``field``, ``us`` (event time in microseconds), ``seq`` (arrival order) and ``price``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skytally.functions import fees as FE
from skytally.functions.market import move_fraction, move_target
from skytally.functions.stats import normal_cdf
from skytally.operators.scale import BLOCK, CORE, asof, lookback, running

SECOND = 1_000_000
HOUR = 3600 * SECOND


def trailing_features(ticks: DataFrame, keys: Sequence[str], looks: dict[str, int], flow: int, block: int) -> DataFrame:
    """Price minus its mean over (t - look, t], and taker quantities over [t - flow, t].

    Rows at one instant are merged first (sums and counts), so a burst of prints is one frame row.
    """
    buy, sell = F.when(~F.col("buyer_maker"), F.col("qty")), F.when(F.col("buyer_maker"), F.col("qty"))
    moments = ticks.groupBy(*keys, "us").agg(
        F.sum("price").alias("_p"), F.count("price").alias("_n"), F.coalesce(F.sum(buy), F.lit(0.0)).alias("_b"), F.coalesce(F.sum(sell), F.lit(0.0)).alias("_s"))
    spread = lookback(moments, "us", max([flow, *looks.values()]), block)
    order = Window.partitionBy(*keys, BLOCK).orderBy("us")
    mean = lambda w: F.sum("_p").over(order.rangeBetween(-w + 1, 0)) / F.sum("_n").over(order.rangeBetween(-w + 1, 0))
    inside = order.rangeBetween(-flow, 0)
    framed = spread.select(
        *keys, "us", CORE, *[mean(w).alias(f"_m_{n}") for n, w in looks.items()],
        F.sum("_b").over(inside).alias("taker_buy_qty"), F.sum("_s").over(inside).alias("taker_sell_qty"),
    ).filter(CORE).drop(CORE)
    out = ticks.join(framed, [*keys, "us"])
    return out.select(
        *ticks.columns, *[(F.col("price") - F.col(f"_m_{n}")).alias(f"delta_{n}") for n in looks],
        "taker_buy_qty", "taker_sell_qty", (F.col("taker_buy_qty") - F.col("taker_sell_qty")).alias("taker_imbalance"),
    )


def _blocked(ticks: DataFrame, block: int) -> DataFrame:
    return ticks.withColumn(BLOCK, F.floor(F.col("us") / block).cast("long"))


def with_previous(ticks: DataFrame, keys: Sequence[str] = ("asset", "field"), block: int = 24 * HOUR) -> DataFrame:
    """Last positive price before the row, and the directional move from it."""
    p = F.col("price")
    out = running(_blocked(ticks, block), list(keys), [BLOCK], ["us", "seq"], {"previous_price": ("last", F.when(p > 0, p), True)}).drop(BLOCK)
    return out.withColumn("change_fraction", F.when(F.col("previous_price").isNotNull(), move_fraction(F.col("previous_price"), p)))


def changed_only(ticks: DataFrame, keys: Sequence[str] = ("asset", "field"), block: int = 24 * HOUR) -> DataFrame:
    """Rows whose price differs from the row before by more than 1e-9."""
    out = running(_blocked(ticks, block), list(keys), [BLOCK], ["us", "seq"], {"_was": ("last", F.col("price"), True)}).drop(BLOCK)
    return out.filter(F.col("_was").isNull() | (F.abs(F.col("price") - F.col("_was")) > 1e-9)).drop("_was")


def recent_mean(ticks: DataFrame, points: int, keys: Sequence[str] = ("asset", "field"), block: int = 24 * HOUR, history: int = 200, run: int = 5000) -> DataFrame:
    """Mean of the last ``points`` distinct prices up to each kept row; zeros are dropped after the slice.

    Rows get their position in the series; frames run over runs of positions with an overlap of ``points``.
    """
    if points > history:
        raise ValueError(f"points is {points}, more than the history of {history}")
    points = max(1, points)
    kept = changed_only(ticks, keys, block)
    placed = running(_blocked(kept, block), list(keys), [BLOCK], ["us", "seq"], {"_pos": ("count", F.lit(1))}).drop(BLOCK)
    spread = lookback(placed, "_pos", points - 1, run)
    frame = Window.partitionBy(*keys, BLOCK).orderBy("_pos").rowsBetween(-points + 1, 0)
    mean = F.avg(F.when(F.col("price") > 0, F.col("price"))).over(frame)
    return spread.withColumn("smoothed_price", F.coalesce(mean, F.lit(0.0))).filter(CORE).drop(CORE, BLOCK, "_pos")


def with_drawdown(rows: DataFrame, value: str, limit: float, keys: Sequence[str] = ("asset", "field"), block: int = 24 * HOUR) -> DataFrame:
    """Peak so far, fall from it, and whether the fall reaches ``limit`` of a positive peak."""
    out = running(_blocked(rows, block), list(keys), [BLOCK], ["us", "seq"], {"peak": ("max", F.col(value))}).drop(BLOCK)
    peak = F.greatest(F.lit(0.0), F.col("peak"))
    out = out.withColumn("peak", peak).withColumn("drawdown", F.col("peak") - F.col(value))
    return out.withColumn("breach", (F.col("peak") > 0) & (F.col("drawdown") >= F.col("peak") * min(1.0, max(0.0, limit))))


def price_at(targets: DataFrame, ticks: DataFrame, keys: Sequence[str], block: int = HOUR) -> DataFrame:
    """Price at or before each target time; a target before the first tick gets the earliest price.
    Of several ticks at one instant the last to arrive counts."""
    one = ticks.groupBy(*keys, "us").agg(F.max_by("price", "seq").alias("price"))
    return asof(targets, one, list(keys), "target_us", "us", ["price"], block, first_too=True)


# Windows -------------------------------------------------------------------------------------------------------
def window_moves(ticks: DataFrame, seconds: int = 300, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Open, close, high, low and moves per tumbling window. The first, partial window of a series and
    windows that did not move are left out."""
    width = seconds * SECOND
    good = ticks.filter("price > 0").withColumn("window_us", F.floor(F.col("us") / width) * width)
    order = F.struct("us", "seq")
    w = good.groupBy(*keys, "window_us").agg(
        F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("ticks"))
    first = w.groupBy(*keys).agg(F.min("window_us").alias("_first"))
    w = w.join(first, list(keys)).filter("window_us > _first").drop("_first")
    w = w.withColumn("up_move", F.greatest(F.lit(0.0), F.col("high") - F.col("open"))).withColumn("down_move", F.greatest(F.lit(0.0), F.col("open") - F.col("low")))
    return w.filter("up_move > 0 OR down_move > 0")


def with_average_move(moves: DataFrame, windows: int = 4, keys: Sequence[str] = ("asset",), run: int = 5000) -> DataFrame:
    """Mean of the larger move over the last complete windows; null until there are enough of them."""
    placed = running(moves.withColumn(BLOCK, F.floor(F.col("window_us") / (7 * 24 * HOUR)).cast("long")), list(keys), [BLOCK], ["window_us"], {"_pos": ("count", F.lit(1))}).drop(BLOCK)
    spread = lookback(placed, "_pos", windows, run)
    frame = Window.partitionBy(*keys, BLOCK).orderBy("_pos").rowsBetween(-windows, -1)
    mean = F.when(F.count("*").over(frame) >= windows, F.avg(F.greatest("up_move", "down_move")).over(frame))
    return spread.withColumn("avg_move", mean).filter(CORE).drop(CORE, BLOCK, "_pos")


def elapsed_ms(us: Column, window_us: Column, seconds: int = 300) -> Column:
    """Milliseconds into the window on a 20 ms grid."""
    raw = (us - window_us) / 1000.0
    return F.greatest(F.lit(0.0), F.least(F.lit(seconds * 1000.0), F.bround(raw / 20.0, 0) * 20.0))


def fair_score(delta: Column, avg_move: Column, elapsed: Column, seconds: int = 300, z_at_avg: float = 1.25, floor_seconds: float = 10.0) -> Column:
    """Signed score of the move so far against the usual move, growing as the window runs out."""
    left = F.greatest(F.lit(floor_seconds), seconds - F.least(F.lit(float(seconds)), F.greatest(F.lit(0.0), elapsed / 1000.0)))
    return F.when(avg_move > 0, delta / F.nullif(avg_move, F.lit(0.0)) * z_at_avg * F.sqrt(seconds / left))


def clamp_fair(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(0.01), F.least(F.lit(0.99), p)))


def with_fair_value(ticks: DataFrame, moves: DataFrame, seconds: int = 300, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """UP and DOWN fair values of each tick inside a window that has a known usual move."""
    width = seconds * SECOND
    usual = with_average_move(moves, keys=keys).select(*keys, "window_us", "open", "close", "avg_move")
    t = ticks.filter("price > 0").withColumn("window_us", F.floor(F.col("us") / width) * width)
    out = t.join(usual, [*keys, "window_us"]).withColumn("elapsed_ms", elapsed_ms(F.col("us"), F.col("window_us"), seconds))
    out = out.withColumn("delta", F.col("price") - F.col("open"))
    # One column per step: the score is read many times by the distribution function.
    out = out.withColumn("_z", fair_score(F.col("delta"), F.col("avg_move"), F.col("elapsed_ms"), seconds))
    out = out.withColumn("up_fair", clamp_fair(normal_cdf(F.col("_z")))).drop("_z")
    return out.withColumn("down_fair", clamp_fair(1.0 - F.col("up_fair")))


class Rules:
    """Entry limits of the short-window model; defaults are the published configuration."""

    def __init__(self, low=0.10, high=0.48, early_s=5.0, late_s=30.0, late_floor=0.50, rate=0.07, steps=1, step_max=0.02, seconds=300):
        self.low, self.high, self.early_ms, self.late_ms, self.late_floor = low, high, early_s * 1000, late_s * 1000, late_floor
        self.rate, self.steps, self.seconds = rate, min(steps, int(round(step_max / 0.01))), seconds


def _late_ok(fair: Column, elapsed: Column, r: Rules) -> Column:
    return (r.seconds * 1000.0 - elapsed > r.late_ms) | (fair > r.late_floor)


def decision_reasons(price: Column, fair: Column, elapsed: Column, r: Rules, need: Column | None = None, profit: Column | None = None) -> Column:
    """Why a side is not traded at that price; an empty list means it is."""
    need = FE.required_profit(price) if need is None else need
    profit = FE.expected_profit(price, fair, r.rate) if profit is None else profit
    no_depth = price.isNull() | (price <= 0)
    checks = [
        (no_depth, "insufficient_depth"), (~no_depth & (price < r.low), "below_floor"), (price > r.high, "above_cap"), (elapsed < r.early_ms, "early_window"),
        (need.isNull(), "no_profit_tier"), (need.isNotNull() & (profit < need), "profit_below_tier"), (~_late_ok(fair, elapsed, r), "late_fair_too_low"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def improved_price(price: Column, fair: Column, r: Rules) -> Column:
    """Price raised cent by cent while the profit tier of the raised price still holds."""
    best, alive = F.round(price, 2), F.lit(True)
    for step in range(1, r.steps + 1):
        candidate = F.round(price + 0.01 * step, 2)
        need, profit = FE.required_profit(candidate), FE.expected_profit(candidate, fair, r.rate)
        alive = alive & F.coalesce((candidate <= r.high) & need.isNotNull() & (profit >= need) & (profit >= 0), F.lit(False))
        best = F.when(alive, candidate).otherwise(best)
    return best


def best_candidate(rows: DataFrame, r: Rules) -> DataFrame:
    """The better side per tick among those that pass every check, with the improved price. Both sides are
    columns of the tick, so they are compared within the row."""
    out = rows.filter("up_fair IS NOT NULL").select("asset", "us", "seq", "elapsed_ms", "up_ask", "up_fair", "down_ask", "down_fair")
    for s in ("up", "down"):
        price, fair = F.col(f"{s}_ask"), F.col(f"{s}_fair")
        out = out.withColumns({f"_{s}_need": FE.required_profit(price), f"_{s}_profit": FE.expected_profit(price, fair, r.rate)})

    def offer(s: str, rank: int) -> Column:
        price, fair, need, profit = [F.col(c) for c in (f"{s}_ask", f"{s}_fair", f"_{s}_need", f"_{s}_profit")]
        fine = F.size(decision_reasons(price, fair, F.col("elapsed_ms"), r, need, profit)) == 0
        return F.when(fine, F.struct(profit.alias("profit"), F.lit(rank).alias("rank"), F.lit(s.upper()).alias("side"), price.alias("buy_price"), fair.alias("fair")))

    out = out.withColumns({"_up": offer("up", 1), "_down": offer("down", 0)})
    # At most one element is exploded: rows without an offer go, and later steps read plain columns.
    ranked = F.slice(F.sort_array(F.array_compact(F.array("_up", "_down")), asc=False), 1, 1)
    out = out.select("asset", "us", "seq", F.explode(ranked).alias("b")).select("asset", "us", "seq", "b.side", "b.buy_price", "b.fair", "b.profit")
    return out.withColumn("limit_price", improved_price(F.col("buy_price"), F.col("fair"), r))


def window_outcomes(positions: DataFrame, moves: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Winner of each position's window (close at or above open is UP) and its profit."""
    w = moves.select(*keys, "window_us", F.when(F.col("close") >= F.col("open"), "UP").otherwise("DOWN").alias("winner"))
    out = positions.join(w, [*keys, "window_us"])
    return out.withColumn("profit", F.when(F.col("winner") == F.col("side"), F.col("shares")).otherwise(0.0) - F.col("cost"))


# Report windows --------------------------------------------------------------------------------------------------
def in_windows(ticks: DataFrame, windows: DataFrame, before: int = 0, length: int = 210, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Ticks inside [expected - before, expected + length) of their asset, with the window's expected time.

    Windows are listed under each time cell they touch, so the join is an equality on (asset, cell).
    """
    cell = max(1, before + length)
    at = lambda e: F.floor(e / cell).cast("long")
    w = windows.select(*keys, F.col("expected_epoch"), F.explode(F.sequence(at(F.col("expected_epoch") - before), at(F.col("expected_epoch") + length - 1))).alias("_cell"))
    t = ticks.withColumn("_s", F.col("us") / float(SECOND)).withColumn("_cell", at(F.floor(F.col("_s"))))
    inside = (F.col("_s") >= F.col("expected_epoch") - before) & (F.col("_s") < F.col("expected_epoch") + length)
    return t.join(w, [*keys, "_cell"]).filter(inside).drop("_cell", "_s")


def momentum_triggers(ticks: DataFrame, windows: DataFrame, fraction: float = 0.3, length: int = 210, max_price: float = 1.0, signal: Sequence[str] = ("last_price", "best_bid")) -> DataFrame:
    """First tick per (asset, field, window) that rose far enough from the window's base price.

    The base is the price before the first rising tick in the window. Both picks are partial aggregations.
    """
    keys = ["asset", "field", "expected_epoch"]
    moved = with_previous(ticks.filter(F.col("field").isin(*signal)))
    rising = in_windows(moved, windows, 0, length).filter((F.col("previous_price") > 0) & (F.col("price") > F.col("previous_price")) & (F.col("price") <= max_price))
    base = rising.groupBy(*keys).agg(F.min_by("previous_price", F.struct("us", "seq")).alias("base_price"))
    hit = rising.join(base, keys).filter(F.col("price") >= move_target(F.col("base_price"), fraction))
    first = hit.groupBy(*keys, "base_price").agg(F.min_by(F.struct("us", "seq", "price"), F.struct("us", "seq")).alias("t"))
    return first.select(*keys, "base_price", F.col("t.us").alias("us"), F.col("t.seq").alias("seq"), F.col("t.price").alias("price"))


def window_capture(ticks: DataFrame, windows: DataFrame, length: int = 300, block: int = 24 * HOUR) -> DataFrame:
    """Baseline rows (last price per asset and field at the window start) followed by the window's ticks."""
    fields = ticks.select("asset", "field").distinct()
    starts = windows.join(fields, "asset").withColumn("target_us", F.col("expected_epoch") * SECOND - 1)
    one = ticks.groupBy("asset", "field", "us").agg(F.max_by("price", "seq").alias("price"))
    base = asof(starts, one, ["asset", "field"], "target_us", "us", ["price"], block).filter("asof_price IS NOT NULL")
    base = base.select("asset", "field", "expected_epoch", F.lit("baseline").alias("kind"), (F.col("expected_epoch") * SECOND).alias("us"), F.col("asof_price").alias("price"), F.lit(-1).cast("long").alias("seq"))
    inside = in_windows(ticks, windows, 0, length).select("asset", "field", "expected_epoch", F.lit("tick").alias("kind"), "us", "price", "seq")
    return base.unionByName(inside)


# Observations ----------------------------------------------------------------------------------------------------
def observation_changes(obs: DataFrame, block: int = 7 * 86400) -> DataFrame:
    """Rows whose time or temperature (beyond 1e-9) differs from the row before of the station."""
    cut = obs.withColumn(BLOCK, F.floor(F.col("epoch") / block).cast("long"))
    out = running(cut, ["station"], [BLOCK], ["epoch", "seq"], {"_was": ("last", F.struct(F.col("epoch").alias("e"), F.col("temp_c").alias("t")), True)}).drop(BLOCK)
    was = F.col("_was")
    other = (was["e"] != F.col("epoch")) | F.coalesce(F.abs(was["t"] - F.col("temp_c")) > 1e-9, ~was["t"].eqNullSafe(F.col("temp_c")))
    return out.filter(was.isNull() | other).drop("_was")


def observed_extremes(obs: DataFrame) -> DataFrame:
    """High, low, latest time and count per station-local day: whole degrees per point first, and of several
    points at one time the last counts."""
    from skytally.operators.scale import latest_by

    points = latest_by(obs, ["station", "local_date", "epoch"], [F.col("seq")], ["whole_temp"])
    return points.groupBy("station", "local_date").agg(
        F.max("whole_temp").alias("high"), F.min("whole_temp").alias("low"), F.max("epoch").alias("latest_epoch"), F.count("*").alias("points"))
