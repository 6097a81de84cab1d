"""Books, ticks, windows and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally.functions.stats import normal_cdf_sql
from skytally.functions.units import c_to_f, half_even, tidy
from skytally.operators import books as B
from skytally.operators import logs as G
from skytally.operators import ticks as T
from skytally.operators.observations import with_local_date
from skytally.plans.q_observations import SQL_LOCAL
from skytally.plans.registry import query, r

# Books -------------------------------------------------------------------------------------------------------
SQL_BOOK = ", ml AS (SELECT market_id, token, side, round(price, 4) AS price, sum(size) AS size FROM levels WHERE price > 0 AND size > 0 GROUP BY 1, 2, 3, 4)"
SQL_BUY = SQL_BOOK + (
    ", bl AS (SELECT market_id, CASE WHEN side = 'ask' THEN token WHEN token = 'YES' THEN 'NO' ELSE 'YES' END AS token, CASE WHEN side = 'ask' THEN 'direct' ELSE 'complement' END AS source,"
    " CASE WHEN side = 'ask' THEN price ELSE 1.0e0 - price END AS price, size FROM ml),"
    " cu AS (SELECT *, sum(price * size) OVER w AS cn, sum(size) OVER w AS cs, row_number() OVER w AS rn, count(*) OVER (PARTITION BY market_id, token, source) AS n FROM bl WHERE price > 0 WINDOW w AS (PARTITION BY market_id, token, source ORDER BY price ROWS UNBOUNDED PRECEDING))"
)


@query("arr4_sorted_book", "levels", SQL_BOOK + f" SELECT market_id, token, side, array_to_string(list(concat({r('price', 2)}, 'x', CAST(size AS BIGINT)) ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END), ' ') AS book FROM ml GROUP BY 1, 2, 3")
def arr4(v):
    text = F.array_join(F.transform("levels", lambda x: F.concat(F.round(x["price"], 2), F.lit("x"), x["size"].cast("long"))), " ")
    return B.sorted_book(v.levels).select("market_id", "token", "side", text.alias("book"))


@query("win13_depth_price_notional", "levels", SQL_BUY + f" SELECT market_id, token, source, {r('min(price) FILTER (WHERE cn >= 15.00371)')} AS depth_price FROM cu GROUP BY 1, 2, 3 HAVING max(cn) >= 15.00371")
def win13(v):
    return B.depth_price(B.buy_levels(v.levels), ["market_id", "token", "source"], 15.00371).withColumn("depth_price", tidy(F.col("depth_price")))


@query(
    "win13_depth_price_extra_level", "levels",
    SQL_BUY + f", h AS (SELECT market_id, token, source, least(min(rn) FILTER (WHERE cn >= 15.00371) + 1, max(n)) AS k FROM cu GROUP BY 1, 2, 3 HAVING max(cn) >= 15.00371) SELECT h.market_id, h.token, h.source, {r('cu.price')} AS depth_price FROM h JOIN cu ON h.market_id = cu.market_id AND h.token = cu.token AND h.source = cu.source AND h.k = cu.rn",
)
def win13b(v):
    return B.depth_price(B.buy_levels(v.levels), ["market_id", "token", "source"], 15.00371, extra=1).withColumn("depth_price", tidy(F.col("depth_price")))


@query(
    "win13_sell_price_shares", "levels",
    SQL_BOOK + ", s AS (SELECT *, sum(size) OVER (PARTITION BY market_id, token ORDER BY price DESC ROWS UNBOUNDED PRECEDING) AS c FROM ml WHERE side = 'bid')"
    f" SELECT market_id, token, {r('max(price)')} AS depth_price FROM s WHERE c >= 60 GROUP BY 1, 2",
)
def win13c(v):
    bids = B.merge_levels(v.levels).filter("side = 'bid'")
    return B.depth_price(bids, ["market_id", "token"], 60, "shares", descending=True).withColumn("depth_price", tidy(F.col("depth_price")))


@query("joi22_best_buy_price", "levels", SQL_BUY + f", d AS (SELECT market_id, token, source, min(price) FILTER (WHERE cs >= 40) AS p FROM cu GROUP BY 1, 2, 3) SELECT market_id, token, {r('min(p)')} AS buy_price FROM d GROUP BY 1, 2 HAVING min(p) IS NOT NULL")
def joi22(v):
    return B.best_buy(v.levels, 40, "shares").withColumn("buy_price", tidy(F.col("buy_price")))


@query(
    "joi22_best_sell_and_offer", "levels",
    SQL_BUY + ", s AS (SELECT market_id, CASE WHEN side = 'bid' THEN token WHEN token = 'YES' THEN 'NO' ELSE 'YES' END AS token, max(CASE WHEN side = 'bid' THEN price ELSE 1.0e0 - price END) AS p FROM ml GROUP BY 1, 2),"
    " o AS (SELECT market_id, token, first(price ORDER BY price, source DESC) AS op, first(size ORDER BY price, source DESC) AS os FROM bl WHERE price > 0 GROUP BY 1, 2)"
    f" SELECT s.market_id, s.token, {r('p')} AS sell_price, {r('op')} AS offer_price, os AS offer_size FROM s JOIN o ON s.market_id = o.market_id AND s.token = o.token",
)
def joi22b(v):
    out = B.best_sell(v.levels).join(B.best_offer(v.levels), ["market_id", "token"])
    return out.select("market_id", "token", tidy(F.col("sell_price")).alias("sell_price"), tidy(F.col("offer_price")).alias("offer_price"), "offer_size")


@query(
    "win14_fillable_now", "levels",
    SQL_BUY + ", t AS (SELECT *, 25.0037 - (cn - price * size) AS lf FROM cu WHERE price <= 0.8), u AS (SELECT market_id, token, source, sum(least(size, lf / price)) AS sh, max(price) AS lm FROM t WHERE lf > 0 GROUP BY 1, 2, 3),"
    f" x AS (SELECT *, floor(least(sh, 25.0037 / lm)) AS os FROM u WHERE sh >= 1), y AS (SELECT market_id, token, source, {r('lm', 2)} AS price, os AS order_shares, {r('os * lm', 2)} AS amount_usd FROM x WHERE os >= 1)"
    " SELECT market_id, token, price, order_shares, amount_usd FROM (SELECT *, row_number() OVER (PARTITION BY market_id, token ORDER BY amount_usd DESC, price, source DESC) AS k FROM y) WHERE k = 1",
)
def win14(v):
    return B.fillable(v.levels, 25.0037, 0.8)


# Ticks -------------------------------------------------------------------------------------------------------
LOOKS = {"40": 2400, "100": 6000, "250": 15000, "500": 30000}  # seconds here; the given ticks are minutes apart


@query(
    "win9_win10_trailing_flow", "ticks",
    "SELECT seq, " + ", ".join(f"{r(f'price - avg(price) OVER (PARTITION BY asset ORDER BY us RANGE BETWEEN {s * 1000000 - 1} PRECEDING AND CURRENT ROW)')} AS delta_{n}" for n, s in LOOKS.items())
    + f", {r('coalesce(sum(CASE WHEN NOT buyer_maker THEN qty END) OVER f, 0)')} AS taker_buy_qty, {r('coalesce(sum(CASE WHEN buyer_maker THEN qty END) OVER f, 0)')} AS taker_sell_qty FROM ticks WINDOW f AS (PARTITION BY asset ORDER BY us RANGE BETWEEN 30000000000 PRECEDING AND CURRENT ROW)",
)
def win9(v):
    looks = {n: s * T.SECOND for n, s in LOOKS.items()}
    out = T.trailing_features(v.ticks, ["asset"], looks, 30000 * T.SECOND, 7 * 24 * T.HOUR)
    return out.select("seq", *[tidy(F.col(c)).alias(c) for c in (*[f"delta_{n}" for n in looks], "taker_buy_qty", "taker_sell_qty")])


_PREV = "last_value(CASE WHEN price > 0 THEN price END IGNORE NULLS) OVER (PARTITION BY asset, field ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _move(prev: str, now: str) -> str:
    return f"CASE WHEN {now} >= least(0.999999, {prev}) THEN (least(1, {now}) - least(0.999999, {prev})) / greatest(1e-9, 1 - least(0.999999, {prev})) ELSE ({prev} - {now}) / {prev} END"


@query("win15_previous_price", "ticks", f", p AS (SELECT *, {_PREV} AS pp FROM ticks) SELECT seq, pp AS previous_price, CASE WHEN pp IS NOT NULL THEN {r(_move('pp', 'price'))} END AS change_fraction FROM p")
def win15(v):
    return T.with_previous(v.ticks).select("seq", "previous_price", tidy(F.col("change_fraction")).alias("change_fraction"))


SQL_COARSE = ", c AS (SELECT asset, field, us, seq, CASE WHEN seq % 3 = 0 THEN 0.5e0 ELSE round(price, 1) END AS price FROM ticks), l AS (SELECT *, lag(price) OVER (PARTITION BY asset, field ORDER BY us, seq) AS w FROM c), kept AS (SELECT * FROM l WHERE w IS NULL OR abs(price - w) > 1e-9)"


def _coarse(v):
    return v.ticks.select("asset", "field", "us", "seq", F.when(F.col("seq") % 3 == 0, 0.5).otherwise(F.round("price", 1)).alias("price"))


@query("win11_changed_prices", "ticks", SQL_COARSE + " SELECT seq, asset, field, price FROM kept")
def win11(v):
    return T.changed_only(_coarse(v)).select("seq", "asset", "field", "price")


@query("win12_recent_mean", "ticks", SQL_COARSE + f" SELECT seq, {r('coalesce(avg(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY asset, field ORDER BY us, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0)')} AS smoothed_price FROM kept")
def win12(v):
    return T.recent_mean(_coarse(v), 5).select("seq", tidy(F.col("smoothed_price")).alias("smoothed_price"))


@query(
    "win17_drawdown", "ticks",
    ", p AS (SELECT seq, price - 0.4 AS x, greatest(0, max(price - 0.4) OVER (PARTITION BY asset, field ORDER BY us, seq ROWS UNBOUNDED PRECEDING)) AS pk FROM ticks)"
    f" SELECT seq, {r('pk')} AS peak, {r('pk - x')} AS drawdown, pk > 0 AND pk - x >= pk * 0.33 AS breach FROM p",
)
def win17(v):
    out = T.with_drawdown(v.ticks.withColumn("x", F.col("price") - 0.4), "x", 0.33)
    return out.select("seq", tidy(F.col("peak")).alias("peak"), tidy(F.col("drawdown")).alias("drawdown"), "breach")


@query(
    "joi8_price_at_or_before", "ticks",
    ", o AS (SELECT asset, us, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2), g AS (SELECT seq, asset, us - 36000000000 AS t FROM ticks WHERE seq % 3 = 0), f AS (SELECT asset, arg_min(price, us) AS fp FROM o GROUP BY 1)"
    " SELECT g.seq, coalesce(o.price, f.fp) AS price FROM g ASOF LEFT JOIN o ON g.asset = o.asset AND g.t >= o.us JOIN f ON g.asset = f.asset",
)
def joi8(v):
    targets = v.ticks.filter("seq % 3 = 0").select("seq", "asset", (F.col("us") - 10 * T.HOUR).alias("target_us"))
    return T.price_at(targets, v.ticks, ["asset"], 24 * T.HOUR).select("seq", F.col("asof_price").alias("price"))


@query(
    "joi8_price_at_or_before_whole", "ticks",
    ", o AS (SELECT asset, us, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2), g AS (SELECT seq, asset, us - 36000000000 AS t FROM ticks), f AS (SELECT asset, arg_min(price, us) AS fp FROM o GROUP BY 1)"
    " SELECT g.seq, coalesce(o.price, f.fp) AS price FROM g ASOF LEFT JOIN o ON g.asset = o.asset AND g.t >= o.us JOIN f ON g.asset = f.asset",
)
def joi8_whole(v):
    targets = v.ticks.select("seq", "asset", (F.col("us") - 10 * T.HOUR).alias("target_us"))
    return T.price_at(targets, v.ticks, ["asset"], 24 * T.HOUR).select("seq", F.col("asof_price").alias("price"))


W = 21600  # six-hour windows here; the given ticks are minutes apart
SQL_WIN = (
    f", g AS (SELECT *, CAST(floor(us / {W}000000.0e0) AS BIGINT) * {W}000000 AS window_us FROM ticks WHERE price > 0), w0 AS (SELECT asset, window_us, first(price ORDER BY us, seq) AS open, last(price ORDER BY us, seq) AS close, max(price) AS high, min(price) AS low, count(*) AS ticks FROM g GROUP BY 1, 2),"
    " wm AS (SELECT *, greatest(0, high - open) AS up_move, greatest(0, open - low) AS down_move FROM w0 WHERE window_us > (SELECT min(window_us) FROM w0 z WHERE z.asset = w0.asset) AND (high > open OR low < open)),"
    " wa AS (SELECT *, CASE WHEN count(*) OVER q >= 4 THEN avg(greatest(up_move, down_move)) OVER q END AS avg_move FROM wm WINDOW q AS (PARTITION BY asset ORDER BY window_us ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"
)


@query("str1_window_moves", "ticks", SQL_WIN + f" SELECT asset, window_us, open, close, high, low, ticks, {r('up_move')} AS up_move, {r('down_move')} AS down_move FROM wm")
def str1(v):
    out = T.window_moves(v.ticks, W)
    return out.select("asset", "window_us", "open", "close", "high", "low", "ticks", tidy(F.col("up_move")).alias("up_move"), tidy(F.col("down_move")).alias("down_move"))


@query("agg24_average_move", "ticks", SQL_WIN + f" SELECT asset, window_us, {r('avg_move')} AS avg_move FROM wa")
def agg24(v):
    return T.with_average_move(T.window_moves(v.ticks, W)).select("asset", "window_us", tidy(F.col("avg_move")).alias("avg_move"))


SQL_FAIR = SQL_WIN + (
    f", t AS (SELECT g.asset, g.us, g.seq, g.price, wa.window_us, wa.open, wa.close, wa.avg_move, greatest(0, least({W}000.0e0, round_even((g.us - wa.window_us) / 1000.0e0 / 20.0e0, 0) * 20.0e0)) AS el, g.price - wa.open AS delta FROM g JOIN wa ON g.asset = wa.asset AND g.window_us = wa.window_us),"
    f" z AS (SELECT *, abs(delta) / nullif(avg_move, 0) * 1.25e0 * sqrt({W} / greatest(10, {W} - least({W}, greatest(0, el / 1000.0e0)))) AS zz FROM t), f0 AS (SELECT *, {normal_cdf_sql('zz')} AS ph FROM z),"
    " f1 AS (SELECT *, CASE WHEN avg_move > 0 THEN greatest(0.01, least(0.99, CASE WHEN delta >= 0 THEN ph ELSE 1 - ph END)) END AS up_fair FROM f0), fv AS (SELECT *, CASE WHEN up_fair IS NOT NULL THEN greatest(0.01, least(0.99, 1 - up_fair)) END AS down_fair FROM f1)"
)


def _fair(v):
    out = T.with_fair_value(v.ticks, T.window_moves(v.ticks, W), W)
    return out.withColumn("down_fair", F.when(F.col("up_fair").isNotNull(), F.col("down_fair")))


@query("mkt15_fair_value", "ticks", SQL_FAIR + f" SELECT seq, el AS elapsed_ms, {r('up_fair')} AS up_fair, {r('down_fair')} AS down_fair FROM fv")
def mkt15(v):
    return _fair(v).select("seq", "elapsed_ms", tidy(F.col("up_fair")).alias("up_fair"), tidy(F.col("down_fair")).alias("down_fair"))


def _tier(p: str) -> str:
    from skytally.functions.fees import PROFIT_TIERS

    return f"CASE WHEN {p} <= 0 THEN NULL " + " ".join(f"WHEN {p} <= {u} + 1e-9 THEN {w}" for u, w in PROFIT_TIERS) + " END"


def _cl(p: str) -> str:
    return f"least(0.99, greatest(0.01, {p}))"


def _prof(p: str, f: str) -> str:
    cost = f"({p} + 0.07 * {_cl(p)} * (1 - {_cl(p)}))"
    return f"((greatest(0, {f} - 0.07 * {_cl(f)} * (1 - {_cl(f)})) - {cost}) / {cost})"


SQL_SIDES = SQL_FAIR + (
    ", sd AS (SELECT asset, us, seq, el, 'UP' AS side, 0 AS o, (5 + seq % 60) / 100.0e0 AS p, up_fair AS f FROM fv WHERE up_fair IS NOT NULL UNION ALL SELECT asset, us, seq, el, 'DOWN', 1, (97 - seq % 60 - 5) / 100.0e0, down_fair FROM fv WHERE up_fair IS NOT NULL),"
    f" ck AS (SELECT *, CAST({_tier('p')} AS DOUBLE) AS need, {_prof('p', 'f')} AS profit, ({W}000.0e0 - el > 30000 OR f > 0.5) AS late_ok FROM sd)"
)


def _quoted(v):
    return _fair(v).withColumn("up_ask", (5 + F.col("seq") % 60) / 100.0).withColumn("down_ask", (97 - F.col("seq") % 60 - 5) / 100.0)


@query(
    "mkt17_decision_reasons", "ticks",
    SQL_SIDES + " SELECT seq, side, array_to_string(list_filter([CASE WHEN p <= 0 THEN 'insufficient_depth' END, CASE WHEN p > 0 AND p < 0.1 THEN 'below_floor' END, CASE WHEN p > 0.48 THEN 'above_cap' END, CASE WHEN el < 5000 THEN 'early_window' END,"
    " CASE WHEN need IS NULL THEN 'no_profit_tier' END, CASE WHEN need IS NOT NULL AND profit < need THEN 'profit_below_tier' END, CASE WHEN NOT late_ok THEN 'late_fair_too_low' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ck",
)
def mkt17(v):
    rules = T.Rules(seconds=W)
    q = _quoted(v).filter("up_fair IS NOT NULL")
    one = lambda side, p, f: q.select("seq", F.lit(side).alias("side"), F.array_join(T.decision_reasons(F.col(p), F.col(f), F.col("elapsed_ms"), rules), ",").alias("reasons"))
    return one("UP", "up_ask", "up_fair").unionByName(one("DOWN", "down_ask", "down_fair"))


@query(
    "mkt16_best_candidate", "ticks",
    SQL_SIDES + ", okk AS (SELECT *, row_number() OVER (PARTITION BY asset, us, seq ORDER BY profit DESC, o) AS k FROM ck WHERE p >= 0.1 AND p <= 0.48 AND el >= 5000 AND need IS NOT NULL AND profit >= need AND late_ok), b AS (SELECT *, round(p + 0.01, 2) AS c FROM okk WHERE k = 1)"
    f" SELECT seq, side, p AS buy_price, {r('f')} AS fair, {r('profit')} AS profit, CASE WHEN c <= 0.48 AND {_tier('c')} IS NOT NULL AND {_prof('c', 'f')} >= {_tier('c')} AND {_prof('c', 'f')} >= 0 THEN c ELSE p END AS limit_price FROM b",
)
def mkt16(v):
    out = T.best_candidate(_quoted(v), T.Rules(seconds=W))
    return out.select("seq", "side", "buy_price", tidy(F.col("fair")).alias("fair"), tidy(F.col("profit")).alias("profit"), "limit_price")


@query(
    "mkt18_window_outcomes", "ticks",
    SQL_WIN + f", ps AS (SELECT seq, asset, CAST(floor(us / {W}000000.0e0) AS BIGINT) * {W}000000 AS window_us, CASE WHEN seq % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS side, qty AS shares, qty * price AS cost FROM ticks WHERE seq % 4 < 2)"
    f" SELECT seq, CASE WHEN close >= open THEN 'UP' ELSE 'DOWN' END AS winner, {r('CASE WHEN (close >= open) = (side = $$UP$$) THEN shares ELSE 0 END - cost')} AS profit FROM ps JOIN wm ON ps.asset = wm.asset AND ps.window_us = wm.window_us",
)
def mkt18(v):
    ps = v.ticks.filter("seq % 4 < 2").select("seq", "asset", (F.floor(F.col("us") / (W * T.SECOND)) * (W * T.SECOND)).alias("window_us"),
                                              F.when(F.col("seq") % 2 == 0, "UP").otherwise("DOWN").alias("side"), F.col("qty").alias("shares"), (F.col("qty") * F.col("price")).alias("cost"))
    return T.window_outcomes(ps, T.window_moves(v.ticks, W)).select("seq", "winner", tidy(F.col("profit")).alias("profit"))


@query(
    "mkt18_window_outcomes_whole", "ticks",
    SQL_WIN + f", ps AS (SELECT seq, asset, CAST(floor(us / {W}000000.0e0) AS BIGINT) * {W}000000 AS window_us, CASE WHEN seq % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS side, qty AS shares, qty * price AS cost FROM ticks)"
    f" SELECT seq, CASE WHEN close >= open THEN 'UP' ELSE 'DOWN' END AS winner, {r('CASE WHEN (close >= open) = (side = $$UP$$) THEN shares ELSE 0 END - cost')} AS profit FROM ps JOIN wm ON ps.asset = wm.asset AND ps.window_us = wm.window_us",
)
def mkt18_whole(v):
    ps = v.ticks.select("seq", "asset", (F.floor(F.col("us") / (W * T.SECOND)) * (W * T.SECOND)).alias("window_us"),
                        F.when(F.col("seq") % 2 == 0, "UP").otherwise("DOWN").alias("side"), F.col("qty").alias("shares"), (F.col("qty") * F.col("price")).alias("cost"))
    return T.window_outcomes(ps, T.window_moves(v.ticks, W)).select("seq", "winner", tidy(F.col("profit")).alias("profit"))


# Report windows ------------------------------------------------------------------------------------------------
SQL_SCHED = ", ws AS (SELECT DISTINCT asset, CAST(floor(us / 3600000000.0e0) AS BIGINT) * 3600 + 1380 AS expected_epoch FROM ticks)"


def _windows(v):
    return v.ticks.select("asset", (F.floor(F.col("us") / T.HOUR) * 3600 + 1380).alias("expected_epoch")).distinct()


@query("joi24_str3_window_gate", "ticks", SQL_SCHED + " SELECT t.seq, w.expected_epoch FROM ticks t JOIN ws w ON t.asset = w.asset AND t.us / 1000000.0e0 >= w.expected_epoch - 120 AND t.us / 1000000.0e0 < w.expected_epoch + 1800")
def joi24(v):
    return T.in_windows(v.ticks, _windows(v), 120, 1800).select("seq", "expected_epoch")


@query(
    "str5_momentum_triggers", "ticks",
    SQL_SCHED + f", s AS (SELECT * FROM ticks WHERE field IN ('last_price', 'best_bid')), p AS (SELECT *, {_PREV.replace('ticks', 's')} AS pp FROM s), x AS (SELECT p.*, w.expected_epoch FROM p JOIN ws w ON p.asset = w.asset AND us / 1000000.0e0 >= w.expected_epoch AND us / 1000000.0e0 < w.expected_epoch + 1800 WHERE pp > 0 AND price > pp),"
    " y AS (SELECT *, first_value(pp) OVER (PARTITION BY asset, field, expected_epoch ORDER BY us, seq) AS base_price FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY asset, field, expected_epoch ORDER BY us, seq) AS k FROM y WHERE price >= base_price + 0.3e0 * (1.0e0 - base_price))"
    " SELECT asset, field, expected_epoch, base_price, seq, price FROM z WHERE k = 1",
)
def str5(v):
    return T.momentum_triggers(v.ticks, _windows(v), 0.3, 1800).drop("us")


@query(
    "str4_window_capture", "ticks",
    SQL_SCHED + ", f AS (SELECT DISTINCT asset, field FROM ticks), o AS (SELECT asset, field, us, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2, 3), b AS (SELECT w.asset, f.field, w.expected_epoch, w.expected_epoch * 1000000 - 1 AS t FROM ws w JOIN f ON w.asset = f.asset),"
    " c AS (SELECT b.*, o.price FROM b ASOF JOIN o ON b.asset = o.asset AND b.field = o.field AND b.t >= o.us) SELECT asset, field, expected_epoch, 'baseline' AS kind, price, CAST(-1 AS BIGINT) AS seq FROM c"
    " UNION ALL SELECT t.asset, t.field, w.expected_epoch, 'tick', t.price, t.seq FROM ticks t JOIN ws w ON t.asset = w.asset AND t.us / 1000000.0e0 >= w.expected_epoch AND t.us / 1000000.0e0 < w.expected_epoch + 300",
)
def str4(v):
    return T.window_capture(v.ticks, _windows(v), 300).drop("us")


SQL_OBSC = ", c AS (SELECT station, epoch, seq, CASE WHEN tenths IS NOT NULL THEN round(tenths / 100.0e0, 0) END AS temp_c FROM obs)"


@query(
    "str6_observation_changes", "obs",
    SQL_OBSC + ", l AS (SELECT *, lag(epoch) OVER w AS pe, lag(temp_c) OVER w AS pt FROM c WINDOW w AS (PARTITION BY station ORDER BY epoch, seq)) SELECT seq, station FROM l WHERE pe IS NULL OR pe <> epoch OR pt IS DISTINCT FROM temp_c",
)
def str6(v):
    obs = v.obs.select("station", "epoch", "seq", F.round(F.col("tenths") / 100.0, 0).alias("temp_c"))
    return T.observation_changes(obs).select("seq", "station")


@query(
    "agg20_str7_observed_extremes", "obs",
    f", p AS (SELECT station, CAST({SQL_LOCAL} AS DATE) AS local_date, epoch, arg_max(CAST(round_even(tenths / 10.0e0 * 9.0e0 / 5.0e0 + 32.0e0, 0) AS BIGINT), seq) AS t FROM obs WHERE tenths IS NOT NULL GROUP BY 1, 2, 3)"
    " SELECT station, local_date, max(t) AS high, min(t) AS low, max(epoch) AS latest_epoch, count(*) AS points FROM p GROUP BY 1, 2",
)
def agg20(v):
    obs = with_local_date(v.obs.filter("tenths IS NOT NULL")).withColumn("whole_temp", half_even(c_to_f(F.col("tenths") / 10.0)))
    return T.observed_extremes(obs)


# Logs --------------------------------------------------------------------------------------------------------
@query("par13_log_stamp", "log_lines", "SELECT line_id, regexp_extract(value, '^(\\d{4}-\\d{2}-\\d{2}) (\\d{2}:\\d{2}:\\d{2})', 1) AS line_date, regexp_extract(value, '^(\\d{4}-\\d{2}-\\d{2}) (\\d{2}:\\d{2}:\\d{2})', 2) AS line_time FROM log_lines")
def par13(v):
    return G.with_stamp(v.log_lines).select("line_id", "line_date", "line_time")


@query(
    "flt6_log_filter", "log_lines",
    "SELECT line_id FROM log_lines WHERE substr(value, 12, 8) >= '03:00:00' AND substr(value, 12, 8) <= '20:30:00' AND (contains(value, ' ERROR ') OR contains(value, ' CRITICAL ') OR contains(value, 'Traceback') OR contains(value, 'Exception')"
    " OR ((contains(lower(value), 'kaus') OR contains(lower(value), 'kden')) AND (" + " OR ".join(f"contains(lower(value), '{d.lower()}')" for d in G.DIAGNOSTICS) + ")))",
)
def flt6(v):
    return G.filter_lines(v.log_lines, ["KAUS", "kden"], global_errors=True, start="03:00:00", end="20:30:00").select("line_id")
