"""Interval markets against predictions and observed extremes.

Value-in-interval work is an equi-join on (event, cell): an interval is listed under each ten-degree cell it
touches, a value under the one it lies in, and the exact bounds are checked on the match. Open ends stop at
the outermost cells, which also take every value beyond them, so nothing is lost. Nearest-interval work is a
last-known-value pass, not a join of every pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skytally.functions import market as K
from skytally.functions.stats import normal_cdf
from skytally.functions.units import comparable_bounds, contains, convert, half_up, midpoint_f, rounding_bounds_f
from skytally.operators.scale import earliest_by, running, top_rows

CELL = 10
FIRST, LAST = -30, 40  # cells of -300 .. 409 degrees; values beyond fall in the outermost ones


def _cell(x: Column) -> Column:
    return F.greatest(F.lit(FIRST), F.least(F.lit(LAST), F.floor(x / CELL))).cast("int")


def in_unit(markets: DataFrame, target: str | None = None) -> DataFrame:
    """Add ``lo`` and ``hi`` in the target unit (the market's own by default)."""
    unit = F.col("unit")
    lo, hi = comparable_bounds(F.col("rule_min"), F.col("rule_max"), unit, F.lit(target) if target else unit)
    return markets.withColumn("lo", lo).withColumn("hi", hi)


def finite(markets: DataFrame) -> DataFrame:
    return markets.filter("rule_min IS NOT NULL AND rule_max IS NOT NULL")


def containing(values: DataFrame, markets: DataFrame, value: str = "value", pad: float = 0.0) -> DataFrame:
    """Value rows with each market of their event whose interval, widened by ``pad``, holds the value."""
    m = in_unit(markets).select("event_id", "market_id", "lo", "hi")
    # least/greatest skip nulls, so open ends are set before the clamp.
    first = F.when(F.col("lo").isNull(), FIRST).otherwise(_cell(F.col("lo") - pad))
    last = F.when(F.col("hi").isNull(), LAST).otherwise(_cell(F.col("hi") + pad))
    cells = m.filter("lo IS NULL OR hi IS NULL OR lo <= hi").withColumn("_cell", F.explode(F.sequence(first, last)))
    v = values.withColumn("_cell", _cell(F.col(value)))
    hit = contains(F.col(value), F.col("lo") - pad, F.col("hi") + pad)
    # Spark takes the cells for as small as the markets, so left to itself it would send all of them through the driver.
    return v.join(cells.hint("merge"), ["event_id", "_cell"]).filter(hit).drop("_cell")


def unique_market(values: DataFrame, markets: DataFrame, key: str = "pred_id", value: str = "value") -> DataFrame:
    """The one market that holds the value; no row when none or several do."""
    hits = containing(values.select(key, "event_id", value), markets, value)
    return hits.groupBy(key).agg(F.count("*").alias("_n"), F.min("market_id").alias("market_id")).filter("_n = 1").drop("_n")


def rounded_market(preds: DataFrame, markets: DataFrame, predicted_f: str = "predicted_f") -> DataFrame:
    """As above after rounding half up to whole Fahrenheit; finite intervals only."""
    whole = half_up(F.col(predicted_f))
    v = preds.select("pred_id", "event_id", whole.alias("rounded_f"), convert(whole.cast("double"), F.lit("F"), F.col("unit")).alias("value"))
    return unique_market(v, finite(markets)).join(v.select("pred_id", "rounded_f"), "pred_id")


def adjacent_pair(preds: DataFrame, markets: DataFrame, value: str = "value") -> DataFrame:
    """Two finite markets around a value: both that hold it when exactly two do, none when one or more than
    two do, otherwise the nearest below and the nearest above."""
    fin = in_unit(finite(markets)).select("event_id", "market_id", "rule_min", "rule_max", "unit", "lo", "hi")
    slim = preds.select("pred_id", "event_id", value)
    row = F.struct("lo", "hi", "market_id")
    held = containing(slim, fin, value).groupBy("pred_id").agg(
        F.count("*").alias("matches"), F.min(row).alias("a"), F.max(row).alias("b"))
    # Values and bounds in one order: the last upper bound before a value and the next lower bound after it.
    at = lambda df, order, side, **cols: df.select("event_id", F.col(order).alias("_o"), F.lit(side).alias("_side"), *[F.col(c).alias(n) for n, c in cols.items()])
    line = at(slim, value, 1, pred_id="pred_id").unionByName(
        at(fin.groupBy("event_id", "hi").agg(F.min("market_id").alias("m")), "hi", 0, below="m"), allowMissingColumns=True).unionByName(
        at(fin.groupBy("event_id", "lo").agg(F.min("market_id").alias("m")), "lo", 2, above="m"), allowMissingColumns=True)
    line = line.withColumn("_band", F.floor(F.col("_o") / CELL).cast("long"))
    seen = running(line, ["event_id"], ["_band"], ["_o", "_side"], {"lower_id": ("last", F.col("below")), "upper_id": ("next", F.col("above"))})
    rows = seen.filter("_side = 1").select("pred_id", "lower_id", "upper_id").join(held, "pred_id", "left")
    n = F.coalesce("matches", F.lit(0).cast("long"))
    out = rows.select(
        "pred_id", n.alias("matches"),
        F.when(n == 2, F.col("a.market_id")).when(n == 0, F.col("lower_id")).alias("lower_id"),
        F.when(n == 2, F.col("b.market_id")).when(n == 0, F.col("upper_id")).alias("upper_id"),
    )
    return out.filter("lower_id IS NOT NULL AND upper_id IS NOT NULL")


def boundary_snap(preds: DataFrame, markets: DataFrame, tolerance_f: float, value: str = "value") -> DataFrame:
    """Nearest finite interval that the value misses by at most the tolerance (°F, scaled for Celsius)."""
    eps = 1e-9
    near = containing(preds.select("pred_id", "event_id", "unit", value), finite(markets), value, tolerance_f + eps)
    v = F.col(value)
    gap = F.when(v < F.col("lo"), F.col("lo") - v).when(v > F.col("hi"), v - F.col("hi"))
    allowed = F.when(F.upper("unit") == "C", tolerance_f * 5.0 / 9.0).otherwise(tolerance_f)
    hits = near.withColumn("distance", gap).filter(F.col("distance") <= allowed + eps)
    return earliest_by(hits, ["pred_id"], [F.col("distance"), F.col("market_id").cast("string")], ["market_id", "distance"])


def interval_mass(probabilities: DataFrame, markets: DataFrame) -> DataFrame:
    """Probability per (prediction, finite market) from per-degree rows pred_id, event_id, unit, temp_f, p."""
    v = probabilities.withColumn("value", convert(F.col("temp_f").cast("double"), F.lit("F"), F.col("unit")))
    hits = containing(v, finite(markets))
    return hits.groupBy("pred_id", "market_id").agg(F.sum("p").alias("probability"))


def best_interval(mass: DataFrame, minimum: float = 0.01) -> DataFrame:
    kept = mass.filter(F.col("probability") >= minimum)
    return earliest_by(kept, ["pred_id"], [-F.col("probability"), F.col("market_id").cast("string")], ["market_id", "probability"])


def with_interval_confidence(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """Calibrated normal probability that the outcome rounds into the row's interval; null where the key has
    no calibration or a sigma that is not positive."""
    keys = ["station", "month", "local_hour"]
    cal = calibration.select(*keys, F.col("error_mean_f").alias("_mu"), F.col("error_sigma_f").alias("_sigma"))
    out = rows.withColumn("station", F.upper("station")).join(cal, keys, "left")
    lower, upper = rounding_bounds_f(F.col("rule_min"), F.col("rule_max"), F.col("unit"))
    z = lambda bound: (F.col("predicted_f") - bound - F.col("_mu")) / F.nullif(F.col("_sigma"), F.lit(0.0))
    out = out.withColumn("_zt", z(lower)).withColumn("_zl", z(upper))
    top = F.when(F.col("rule_min").isNull(), 1.0).otherwise(normal_cdf(F.col("_zt")))
    low = F.when(F.col("rule_max").isNull(), 0.0).otherwise(normal_cdf(F.col("_zl")))
    p = F.when(F.col("_sigma") > 0, K.clamp01(top - low))
    return out.withColumn("regressor_probability", p).drop("_mu", "_sigma", "_zt", "_zl")


def combined_probability(classifier: Column, regressor: Column, wc: float = 0.5, wr: float = 0.5) -> Column:
    total = wc + wr
    wc, wr = (0.5, 0.5) if total <= 0 else (wc / total, wr / total)
    return K.clamp01(wc * classifier + wr * regressor)


def with_signal(df: DataFrame, regressor: str, classifier: str, same: str, agree_r: float = 0.60, agree_c: float = 0.70, takeover: float = 0.80, gap: float = 0.30) -> DataFrame:
    """Which of two interval choices to act on, with the reason."""
    r, c = F.col(regressor), F.col(classifier)
    strong = lambda p: p >= takeover
    agree = F.coalesce(r >= agree_r, F.lit(False)) | F.coalesce(c >= agree_c, F.lit(False))
    reason = (
        F.when(F.col(same) & agree, "agreement")
        .when(F.col(same), "skip_agreement_below_thresholds")
        .when(r.isNull() & c.isNull(), "skip_no_probabilities")
        .when(r.isNull(), F.when(strong(c), "classifier_takeover_missing_regressor_confidence").otherwise("skip_classifier_below_takeover_without_regressor"))
        .when(c.isNull(), F.when(strong(r), "regressor_takeover_missing_classifier_probability").otherwise("skip_regressor_below_takeover_without_classifier"))
        .when(F.abs(r - c) <= gap, "skip_disagreement_gap_too_small")
        .when(c > r, F.when(strong(c), "classifier_takeover").otherwise("skip_classifier_takeover_below_threshold"))
        .otherwise(F.when(strong(r), "regressor_takeover").otherwise("skip_regressor_takeover_below_threshold"))
    )
    out = df.withColumn("signal_reason", reason)
    pick = F.when(F.col("signal_reason").startswith("skip"), F.lit(None)).when(F.col("signal_reason").startswith("classifier"), "classifier").otherwise("regressor")
    return out.withColumn("signal_choice", pick)


def price_cap(hour: Column, start_hour: Column, ladder: Sequence[float] = (0.60, 0.70, 0.80)) -> Column:
    """Cap by hours since the buy window opened; the last rung repeats."""
    step = F.least(F.lit(len(ladder) - 1), F.greatest(F.lit(0), hour - start_hour)).cast("int")
    return F.get(F.array(*[F.lit(float(x)) for x in ladder]), step)


def with_candidate(df: DataFrame, price: str, cap: str, minimum: str) -> DataFrame:
    """Executable cents price, edge to the cap, and why a row is not a candidate."""
    p = F.round(F.col(price), 2)
    reason = F.when(F.col("rule_min").isNull() | F.col("rule_max").isNull(), "open_ended").when(F.col(price).isNull() | (F.col(price) <= 0), "no_price").when(
        p < F.col(minimum), "below_floor").when(p > F.col(cap), "above_cap").otherwise("ok")
    out = df.withColumn("candidate_reason", reason)
    ok = F.col("candidate_reason") == "ok"
    return out.withColumn("candidate_price", F.when(ok, p)).withColumn("candidate_edge", F.when(ok, F.col(cap) - p))


# Observed extremes ---------------------------------------------------------------------------------------------
def with_extremes(markets: DataFrame, extremes: DataFrame) -> DataFrame:
    return in_unit(markets).join(extremes.select("event_id", "observed_high", "observed_low"), "event_id")


def with_state(rows: DataFrame) -> DataFrame:
    args = [F.col(c) for c in ("kind", "observed_high", "observed_low", "lo", "hi")]
    return rows.select("*", K.impossible(*args).alias("impossible"), K.possible_again(*args).alias("possible_again"), K.extreme_reached(*args).alias("extreme_reached"))


def reachable(rows: DataFrame) -> DataFrame:
    """Markets still reachable from the observed extreme; without an observation all stay."""
    hi_ok = F.coalesce(F.col("observed_high") <= F.col("hi"), F.lit(True))
    lo_ok = F.coalesce(F.col("observed_low") >= F.col("lo"), F.lit(True))
    kind = F.lower(F.trim("kind"))
    return rows.filter(F.when(kind == "highest", hi_ok).when(kind == "lowest", lo_ok).otherwise(True))


def _highest() -> Column:
    return F.col("kind") == "Highest"


def _edge() -> Column:
    """Order of markets by comparable bounds, open ends at -9999 and 9999, then id (text ids order as text)."""
    return F.struct(F.coalesce("lo", F.lit(-9999.0)).alias("lo"), F.coalesce("hi", F.lit(9999.0)).alias("hi"), F.col("market_id").alias("id"))


def _outermost(pick: Column | str) -> Column:
    """The last market of a Highest event, the first of a Lowest one."""
    high = _highest()
    return F.coalesce(F.max_by(pick, F.when(high, _edge())), F.min_by(pick, F.when(~high, _edge())))


def _innermost(pick: Column | str) -> Column:
    high = _highest()
    return F.coalesce(F.min_by(pick, F.when(high, _edge())), F.max_by(pick, F.when(~high, _edge())))


def ordered(markets: DataFrame) -> DataFrame:
    """Open markets by comparable bounds, reversed for Lowest events, with their position. Positions come from counted
    bands of the lower bound; reversed ones are counted from the end, so ids of any type keep their order."""
    m = in_unit(markets.filter("NOT closed")).withColumn("_edge", _edge())
    m = m.withColumns({"_k1": F.col("_edge.lo"), "_k2": F.col("_edge.hi"), "_band": F.floor(F.col("_edge.lo") / CELL).cast("long")}).drop("_edge")
    out = running(m, ["event_id"], ["_band"], ["_k1", "_k2", "market_id"], {"position": ("count", F.lit(1))})
    size = m.groupBy("event_id").agg(F.count("*").alias("_n"))
    out = out.join(size, "event_id").withColumn("position", F.when(_highest(), F.col("position")).otherwise(F.col("_n") + 1 - F.col("position")))
    return out.drop("_k1", "_k2", "_band", "_n")


def outer_boundary(markets: DataFrame) -> DataFrame:
    m = in_unit(markets.filter("NOT closed"))
    return m.groupBy("event_id", "kind").agg(_outermost("market_id").alias("market_id"))


def _miss(rows: DataFrame) -> DataFrame:
    """Distance of an impossible market from the extreme, and its width."""
    high = F.col("kind") == "Highest"
    d = F.when(high, F.col("observed_high") - F.col("hi")).otherwise(F.col("lo") - F.col("observed_low"))
    width = F.coalesce(F.col("hi") - F.col("lo"), F.lit(9999.0))
    return rows.withColumn("distance", d).withColumn("width", width)


def impossible_by_distance(rows: DataFrame) -> DataFrame:
    """Open impossible markets with their rank by distance, width and id."""
    out = _miss(with_state(rows).filter("NOT closed AND impossible")).withColumn("_band", F.floor(F.col("distance") / CELL).cast("long"))
    return running(out, ["event_id"], ["_band"], ["distance", "width", "market_id"], {"rank": ("count", F.lit(1))}).drop("_band")


def nearest_no_market(rows: DataFrame) -> DataFrame:
    """Market for the NO side: the nearest impossible one, else the nearest still possible one, else the edge
    market. One aggregation per event."""
    state = _miss(with_state(rows).filter("NOT closed"))
    high = F.col("kind") == "Highest"
    ahead = F.when(high, F.col("hi") - F.col("observed_high")).otherwise(F.col("observed_low") - F.col("lo"))
    gone = F.when(F.col("impossible"), F.struct("distance", "width", "market_id"))
    near = F.when(ahead >= 0, F.struct(ahead.alias("d"), "width", "market_id"))
    out = state.groupBy("event_id", "kind").agg(
        F.min(gone).alias("a"), F.min(near).alias("b"), _innermost("market_id").alias("c"))
    return out.select("event_id", "kind", F.coalesce("a.market_id", "b.market_id", "c").alias("market_id"))


def position_checks(trades: DataFrame, rows: DataFrame, expired_after_hours: float = 2.0) -> DataFrame:
    """hold / unwind / unknown / invalid with the reason, for open and hedged trades."""
    m = with_state(rows).select("market_id", "kind", "observed_high", "observed_low", "impossible", "possible_again", "extreme_reached")
    t = trades.filter("status IN ('OPEN', 'HEDGED')").drop("kind").join(m, "market_id")
    seen = F.when(F.col("kind") == "Highest", F.col("observed_high")).otherwise(F.col("observed_low")).isNotNull()
    side = F.upper(F.coalesce("position_side", F.lit("YES")))
    supported = F.when(side == "NO", F.col("impossible")).otherwise(F.col("extreme_reached"))
    why = (
        F.when(F.col("momentum"), "invalidated_price_momentum").when(F.col("price_moved"), "inconsistent_after_price_move")
        .when(F.col("staggered") & F.col("validated_source"), "invalidated_post_buy_validation")
        .when(F.col("age_hours") >= expired_after_hours, "not_verified_in_time")
    )
    state = (
        F.when(~seen, "unknown").when(F.col("status") == "HEDGED", F.when(F.col("possible_again"), "unwind").otherwise("hold"))
        .when(supported, "hold").when(why.isNotNull(), "invalid").otherwise("wait")
    )
    out = t.withColumn("check_state", state)
    return out.withColumn("check_reason", F.when(F.col("check_state") == "invalid", why))


def harvest_plan(rows: DataFrame, held: DataFrame, yes_cap: float = 0.99, no_cap: float = 0.99) -> DataFrame:
    """Per event: YES on the end interval once reached, else NO on the nearest impossible market not yet held.
    ``held`` has market_id and side; prices are yes_price and no_price of the market."""
    flags = held.groupBy("market_id").agg(F.max(F.col("side") == "YES").alias("_hy"), F.max(F.col("side") == "NO").alias("_hn"))
    m = _miss(with_state(rows).filter("NOT closed")).join(flags, "market_id", "left").fillna(False, ["_hy", "_hn"])
    pick = F.struct("market_id", "extreme_reached", "_hy", "yes_price")
    gone = F.when(F.col("impossible") & ~F.col("_hn"), F.struct("distance", "width", "market_id", "no_price"))
    e = m.groupBy("event_id").agg(_outermost(pick).alias("y"), F.min(gone).alias("n"))
    reached = F.col("y.extreme_reached")
    ok = lambda p, cap: (p > 0) & (p <= cap)
    yes = reached & ~F.col("y._hy") & F.coalesce(ok(F.col("y.yes_price"), yes_cap), F.lit(False))
    no = ~reached & F.coalesce(ok(F.col("n.no_price"), no_cap), F.lit(False))
    out = e.select(
        "event_id", F.when(yes, "YES").when(no, "NO").alias("side"),
        F.when(yes, F.col("y.market_id")).when(no, F.col("n.market_id")).alias("market_id"),
        F.when(yes, F.col("y.yes_price")).when(no, F.col("n.no_price")).alias("price"),
    )
    return out.filter("side IS NOT NULL")


def cheapest_no(markets: DataFrame, keep: int = 3, floor: float = 0.0) -> DataFrame:
    """The few cheapest NO markets per event. Leaving out a pair never needs more than three."""
    c = finite(markets).filter((F.col("no_price") > 0) & (F.col("no_price") >= floor)).withColumn("_p", F.round("no_price", 2))
    best = top_rows(c.select("event_id", "market_id", "_p"), ["event_id"], [F.col("_p"), F.col("market_id").cast("string")], keep)
    return best.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("market_id").alias("id"), F.col("_p").alias("price")))).alias("no_list"))


def pair_plan(pairs: DataFrame, quotes: DataFrame, held: DataFrame, yes_floor: float = 0.05, total_cap: float = 0.9, no_cap: float = 0.99, no_floor: float = 0.0) -> DataFrame:
    """What to do with an adjacent pair: both legs, one leg, a cheaper NO elsewhere, the missing leg, or skip.

    ``pairs``: pred_id, event_id, matches, lower_id, upper_id. ``quotes``: event_id, market_id, yes_price,
    no_price, bounds. ``held``: market ids with a YES leg.
    """
    y = quotes.select("market_id", "yes_price").join(held.select("market_id").distinct().withColumn("_h", F.lit(True)), "market_id", "left")
    leg = lambda p: y.select(F.col("market_id").alias(f"{p}_id"), F.round("yes_price", 2).alias(f"{p}_yes"), F.coalesce("_h", F.lit(False)).alias(f"{p}_held"))
    rows = pairs.join(leg("lower"), "lower_id").join(leg("upper"), "upper_id").join(cheapest_no(quotes, floor=no_floor), "event_id", "left")
    lo, up = F.col("lower_yes"), F.col("upper_yes")
    rows = rows.withColumn("pair_total", lo + up)
    other = F.get(F.filter("no_list", lambda s: (s["id"] != F.col("lower_id")) & (s["id"] != F.col("upper_id"))), F.lit(0))
    rows = rows.withColumn("_no", F.when(F.col("matches") == 0, other))
    both_held, one_held = F.col("lower_held") & F.col("upper_held"), F.col("lower_held") | F.col("upper_held")
    cheaper = F.coalesce(F.col("_no.price") < F.col("pair_total"), F.lit(False))
    plan = (
        F.when(lo.isNull() | (lo <= 0) | up.isNull() | (up <= 0), "skip_missing_price")
        .when((lo < yes_floor) & (up < yes_floor), "skip_both_below_floor").when(lo < yes_floor, "single_upper").when(up < yes_floor, "single_lower")
        .when(cheaper & (F.col("_no.price") > no_cap), "skip_no_above_max").when(cheaper, "buy_no_elsewhere")
        .when(F.col("pair_total") > total_cap, "skip_total_above_cap").when(both_held, "skip_both_held")
        .when(one_held, F.when(F.col("lower_held"), "hedge_upper").otherwise("hedge_lower")).otherwise("both_legs")
    )
    return rows.select("pred_id", "event_id", "lower_id", "upper_id", "pair_total", plan.alias("plan"),
                       F.when(plan == "buy_no_elsewhere", F.col("_no.id")).alias("no_market_id"))


def venue_guard(ours: DataFrame, other: DataFrame, threshold_f: float) -> DataFrame:
    """Allow a market only when the other venue's most likely interval lies 0 to ``threshold_f`` above ours.
    A missing piece blocks, with its reason. Ties on probability go to the smaller ticker."""
    p = K.quote_probability(F.col("yes_bid"), F.col("yes_ask"), F.col("last_price"))
    q = other.withColumn("_p", p).filter("_p IS NOT NULL")
    mid = (F.col("floor_strike") + F.col("cap_strike")) / 2.0
    top = earliest_by(q.withColumn("other_mid", mid), ["event_id"], [-F.col("_p"), F.col("ticker")], ["ticker", "other_mid"])
    rows = ours.withColumn("our_mid", midpoint_f(F.col("rule_min"), F.col("rule_max"), F.col("unit"))).join(top, "event_id", "left")
    diff = F.col("other_mid") - F.col("our_mid")
    reason = (
        F.when(F.col("our_mid").isNull(), "our_interval_midpoint_unavailable").when(F.col("ticker").isNull(), "other_market_not_found")
        .when(F.col("other_mid").isNull(), "other_interval_midpoint_unavailable").when(diff < 0, "our_midpoint_above_other")
        .when(diff > threshold_f, "other_midpoint_too_high").otherwise("ok")
    )
    return rows.withColumn("guard_reason", reason).withColumn("allowed", F.col("guard_reason") == "ok").withColumn("mid_diff", diff)


def city_metadata(events: DataFrame) -> DataFrame:
    """First event's details per city and the sorted lists of dates, kinds and titles.

    Date and kind sets are small; titles are counted, not gathered, so a busy city stays one small row.
    """
    order = F.struct("event_date", "kind", "event_id")
    first = F.min_by(F.struct("event_id", "title", "station", "source", "unit"), order).alias("f")
    out = events.groupBy("city").agg(first, F.sort_array(F.collect_set("event_date")).alias("d"), F.sort_array(F.collect_set("kind")).alias("k"), F.count("title").alias("titles"))
    return out.select("city", "f.*", F.array_join("d", ",").alias("event_dates"), F.array_join("k", ",").alias("kinds"), "titles")


def with_source_station(df: DataFrame, text: str, manual: str | None = None) -> DataFrame:
    """Station from the first history-page link, else a timeseries-page link, else the manual one."""
    t = F.col(text)
    page = F.regexp_extract(t, r"(?i)(https?://(?:www\.)?wunderground\.com/history/[^\s\"'<)]+)", 1)
    series = F.regexp_extract(t, r"(?i)https?://[^\s\"'<)]*timeseries\?site=([A-Za-z0-9]{4})", 1)
    hand = F.col(manual) if manual else F.lit("")
    code = K.station_code(page)
    return df.withColumn("station", F.when(code != "", code).when(series != "", F.upper(series)).otherwise(F.coalesce(hand, F.lit("")))).withColumn(
        "source", F.when(code != "", "history").when(series != "", "timeseries").when(F.coalesce(hand, F.lit("")) != "", "manual").otherwise("none"))


def target_events(events: DataFrame, cities: DataFrame, now: str, offsets: Sequence[int] = (0, 1)) -> DataFrame:
    """Events of allowed cities whose date is one of the city's local today + offsets."""
    today = F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), F.col("tz")))
    dates = cities.select("city", F.explode(F.array(*[F.date_add(today, o) for o in offsets])).alias("event_date"))
    return events.join(dates, ["city", "event_date"], "left_semi")
