"""Hand-made rows with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skytally.functions import fees as FE
from skytally.functions import market as K
from skytally.functions import metar as M
from skytally.functions import timeparse as TP
from skytally.functions.stats import normal_cdf
from skytally.functions.units import half_even, half_up
from skytally.ml import splits as S
from skytally.operators import books as B
from skytally.operators import evaluate as E
from skytally.operators import ledger as L
from skytally.operators import markets as MK
from skytally.operators import observations as O
from skytally.operators import ticks as T


def one(spark, *cols, data=((1,),), schema="x int"):
    return spark.createDataFrame(list(data), schema).select(*cols).first()


def test_phi_matches_erf(spark):
    z = [i / 7.0 for i in range(-70, 71)] + [-40.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert max(abs(g - 0.5 * math.erfc(-x / math.sqrt(2))) for g, x in zip(got, z)) < 1e-12


def test_interval_confidence(spark):
    rows = spark.createDataFrame([("kaus", 7, 15, 92.16, 92.0, 93.0, "F"), ("KXXX", 7, 15, 92.16, 92.0, 93.0, "F"), ("KBAD", 7, 15, 92.16, 92.0, 93.0, "F"), ("KAUS", 7, 15, 92.16, None, 93.0, "F")],
                                 "station string, month int, local_hour int, predicted_f double, rule_min double, rule_max double, unit string")
    cal = spark.createDataFrame([("KAUS", 7, 15, 0.0, 1.0), ("KBAD", 7, 15, 0.0, 0.0)], "station string, month int, local_hour int, error_mean_f double, error_sigma_f double")
    phi = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))
    got = {(r.station, r.rule_min): r.regressor_probability for r in MK.with_interval_confidence(rows, cal).collect()}
    assert got[("KAUS", 92.0)] == pytest.approx(phi(0.66) - phi(-1.34), abs=1e-9)
    assert got[("KAUS", None)] == pytest.approx(1 - phi(-1.34), abs=1e-9)
    assert got[("KXXX", 92.0)] is None and got[("KBAD", 92.0)] is None


def _levels(spark, rows):
    return spark.createDataFrame([(1, "YES", s, p, q) for s, p, q in rows], "market_id int, token string, side string, price double, size double")


def test_depth_prices(spark):
    asks = _levels(spark, [("ask", 0.40, 10.0), ("ask", 0.45, 14.0), ("ask", 0.47, 100.0), ("ask", 0.0, 9.0)])
    keys = ["market_id", "token", "source"]
    assert B.depth_price(B.buy_levels(asks), keys, 5.0).first().depth_price == 0.45
    assert B.depth_price(B.buy_levels(asks), keys, 5.0, extra=1).first().depth_price == 0.47
    assert B.depth_price(B.buy_levels(asks), keys, 5.0, extra=9).first().depth_price == 0.47
    assert B.depth_price(B.buy_levels(asks), keys, 5000.0).count() == 0
    bids = B.buy_levels(_levels(spark, [("bid", 0.63, 100.0)]))
    row = B.depth_price(bids, keys, 5.0).first()
    assert row.token == "NO" and row.depth_price == pytest.approx(0.37)


def test_levels_merge_to_four_places(spark):
    r = B.sorted_book(_levels(spark, [("bid", 0.40001, 1.0), ("bid", 0.40004, 2.0), ("bid", 0.5, 1.0)])).first()
    assert [(x.price, x.size) for x in r.levels] == [(0.5, 1.0), (0.4, 3.0)]


def _markets(spark, rows):
    return spark.createDataFrame([(1, i, "Highest", lo, hi, u, closed) for i, lo, hi, u, closed in rows],
                                 "event_id int, market_id int, kind string, rule_min double, rule_max double, unit string, closed boolean")


def _preds(spark, rows):
    return spark.createDataFrame([(i, 1, "F", v, v) for i, v in rows], "pred_id int, event_id int, unit string, predicted_f double, value double")


def test_rounded_and_contained_markets(spark):
    m = _markets(spark, [(1, 94.0, 95.0, "F", False), (2, 96.0, 97.0, "F", False), (3, None, 93.0, "F", False)])
    got = {r.pred_id: (r.market_id, r.rounded_f) for r in MK.rounded_market(_preds(spark, [(1, 95.4), (2, 95.5), (3, 95.49), (4, 77.2)]), m).collect()}
    assert got == {1: (1, 95), 2: (2, 96), 3: (1, 95)}  # the open lower interval never takes a rounded value
    assert {r.pred_id: r.market_id for r in MK.unique_market(_preds(spark, [(4, 77.2), (5, -5000.0), (6, 95.5)]), m).collect()} == {4: 3, 5: 3}


def test_adjacent_pairs(spark):
    m = _markets(spark, [(1, 90.0, 91.0, "F", False), (2, 92.0, 93.0, "F", False), (3, 93.0, 94.0, "F", False), (4, 200.0, 201.0, "F", False)])
    got = {r.pred_id: (r.lower_id, r.upper_id, r.matches) for r in MK.adjacent_pair(_preds(spark, [(1, 91.5), (2, 93.0), (3, 90.5), (4, 50.0), (5, 150.0)]), m).collect()}
    assert got == {1: (1, 2, 0), 2: (2, 3, 2), 5: (3, 4, 0)}


def test_interval_mass(spark):
    m = _markets(spark, [(1, 94.0, 95.0, "F", False), (2, 96.0, 97.0, "F", False), (3, 98.0, None, "F", False)])
    p = spark.createDataFrame([(1, 1, "F", t, q) for t, q in [(94, .20), (95, .21), (96, .33), (97, .20), (98, .01), (99, .05)]], "pred_id int, event_id int, unit string, temp_f int, p double")
    best = MK.best_interval(MK.interval_mass(p, m)).first()
    assert best.market_id == 2 and best.probability == pytest.approx(0.53)


def test_impossible_and_reachable(spark):
    m = MK.in_unit(_markets(spark, [(1, 90.0, 91.0, "F", False), (2, 92.0, 93.0, "F", False), (3, 80.0, 81.0, "F", False), (4, 94.0, 95.0, "F", False), (5, 60.0, 61.0, "F", True)]))
    rows = m.withColumn("observed_high", F.lit(94.0)).withColumn("observed_low", F.lit(None).cast("double"))
    got = [r.market_id for r in MK.impossible_by_distance(rows).orderBy("rank").collect()]
    assert got == [2, 1, 3]
    assert sorted(r.market_id for r in MK.reachable(rows).collect()) == [4]
    assert MK.reachable(rows.withColumn("observed_high", F.lit(None).cast("double"))).count() == 5
    assert MK.nearest_no_market(rows).first().market_id == 2


def test_momentum_prices(spark):
    assert one(spark, K.move_target(F.lit(0.8), 0.3))[0] == pytest.approx(0.86)
    assert one(spark, K.move_target(F.lit(0.1), 0.3))[0] == pytest.approx(0.37)
    assert one(spark, K.move_fraction(F.lit(0.8), F.lit(0.806)))[0] == pytest.approx(0.03)
    assert one(spark, K.move_fraction(F.lit(0.8), F.lit(0.776)))[0] == pytest.approx(0.03)


def test_report_schedules(spark):
    base = dt.datetime(2026, 6, 8, 3, 0)
    a = [("A", base - dt.timedelta(hours=h + 1) + dt.timedelta(minutes=53)) for h in range(24)] + [("A", base - dt.timedelta(minutes=4) - dt.timedelta(hours=5))]
    b = [("B", dt.datetime(2026, 6, 8, h, m)) for h in range(24) for m in (23, 53)] + [("B", dt.datetime(2026, 6, 8, 5, 31))]
    got = {r.station: r for r in O.report_schedule(spark.createDataFrame(a + b, "station string, valid_utc timestamp")).collect()}
    assert (got["A"].scheduled_minutes, got["A"].interval_seconds, got["A"].report_count, got["A"].expected_next) == ("53", 3600, 25, dt.datetime(2026, 6, 8, 3, 53))
    assert (got["B"].scheduled_minutes, got["B"].interval_seconds, got["B"].report_count, got["B"].expected_next) == ("23,53", 1800, 49, dt.datetime(2026, 6, 9, 0, 23))


def test_window_edges(spark):
    e = int(dt.datetime(2026, 6, 8, 17, 53, tzinfo=dt.timezone.utc).timestamp())
    t = spark.createDataFrame([("a", (e + 209) * T.SECOND, 1), ("a", (e + 210) * T.SECOND, 2), ("a", e * T.SECOND, 3), ("a", e * T.SECOND - 1, 4)], "asset string, us long, seq int")
    w = spark.createDataFrame([("a", e)], "asset string, expected_epoch long")
    assert sorted(r.seq for r in T.in_windows(t, w).collect()) == [1, 3]


def test_pushed_extremes(spark):
    obs = spark.createDataFrame([("K", 1, 1, 29.0), ("K", 2, 2, 31.0), ("K", 2, 3, 31.0)], "station string, epoch long, seq long, c double").withColumn("local_date", F.lit("d"))
    r = T.observed_extremes(obs.withColumn("whole_temp", half_even(F.col("c") * 9 / 5 + 32))).first()
    assert (r.low, r.high, r.points) == (84, 88, 2)


def test_times(spark):
    f = lambda s: one(spark, TP.flexible_utc(F.lit(s)))[0]
    assert f("1781278848236") == dt.datetime(2026, 6, 12, 15, 40, 48, 236000)
    assert f("2026-06-12T15:40:48Z") == dt.datetime(2026, 6, 12, 15, 40, 48)
    assert f("nothing") is None
    d = lambda s, today: one(spark, TP.infer_year_date(F.lit(s), F.lit(today).cast("date")))[0]
    assert d("January 5", "2024-12-20") == dt.date(2025, 1, 5)
    assert d("June 25", "2024-12-20") == dt.date(2024, 6, 25)
    assert d("February 30", "2024-12-20") is None


def test_fills(spark):
    rep = spark.createDataFrame([(1, 1, 13.0, 624), (1, 2, 20.0, 980), (1, 3, 20.0, 980), (1, 4, 19.0, 900)], "order_id long, report_no long, cum_shares double, cum_cents long")
    got = L.fill_increments(rep, run=2).orderBy("report_no").collect()
    assert [(r.delta_shares, r.delta_cents, r.is_repeat) for r in got] == [(13.0, 624, False), (7.0, 356, False), (0.0, 0, True), (0.0, 0, True)]
    c = L.with_clamped_fill(spark.createDataFrame([(90.0, 18.9, 0.21, 47.0)], "s double, a double, p double, t double"), "s", "a", "p", "t").first()
    assert (c.fill_shares, round(c.fill_amount, 2), c.fill_status) == (47.0, 9.87, "FILLED")


def test_quotes_and_fees(spark):
    q = lambda b, a, l: one(spark, K.quote_probability(F.lit(b).cast("double"), F.lit(a).cast("double"), F.lit(l).cast("double")))[0]
    assert q(0.22, 0.26, 0.9) == pytest.approx(0.24) and q(0.0, 0.26, 0.9) == 0.9 and q(0.0, None, 0.0) is None
    p = lambda x: one(spark, FE.required_profit(F.lit(x)))[0]
    assert p(0.10) == 4.5 and p(0.1000001) == 3.5 and p(0.76) is None and p(0.0) is None
    d = FE.with_order_size(spark.createDataFrame([(0.29, 5.0, 5.0), (0.0, 5.0, 5.0), (0.005, 5.0, 5.0), (0.9, 3.0, 5.0)], "p double, b double, m double"), "p", "b", "m")
    assert [(r.order_shares, r.order_spend, r.below_minimum) for r in d.collect()] == [(17.0, 4.93, False), (0.0, 0.0, True), (0.0, 0.0, True), (3.0, 2.7, True)]


def test_rounding(spark):
    r = one(spark, half_up(F.lit(-0.5)), half_up(F.lit(0.5)), half_even(F.lit(2.5)), half_even(F.lit(3.5)))
    assert tuple(r) == (0, 1, 2, 4)


METARS = {
    "plain": "KAUS 081753Z 17012G20KT 10SM FEW030 BKN250 31/24 A2992 RMK AO2 SLP123 T03110239 53014 P0005",
    "split": "KAUS 081753Z VRB03KT 1 1/2SM +TSRA BR VV002 M01/M05 A2992",
    "odd": "KAUS 081753Z 00000KT M1/4SM CLR SCT/// ////// //// A3001 RMK SLP987",
    "later": "KAUS 081753Z 10005KT 20010KT 5SM 3SM 10/05 20/15",
    "bare": "KAUS",
    "cloudy": "KAUS 081753Z 10005KT BKN008CB OVC015 M05///",
}


def test_decode_families(spark):
    df = spark.createDataFrame(list(METARS.items()), "n string, metar string")
    g = {r.n: r for r in M.decode(df).collect()}
    a = g["plain"]
    assert (a.wind_dir_degrees, a.wind_speed_kt, a.wind_gust_kt, a.visibility_sm, a.altimeter_inhg) == (170.0, 12.0, 20.0, 10.0, 29.92)
    assert (a.temp_c, a.dewpoint_c, a.sea_level_pressure_hpa, a.pressure_tendency_code, a.pressure_tendency_3h_hpa, a.precip_1h_in) == (31.1, 23.9, 1012.3, 3, 1.4, 0.05)
    assert (a.cloud_layer_count, a.cloud_cover_max, a.lowest_cloud_base_ft, a.lowest_ceiling_ft, a.wx_token_count) == (2, 3, 3000, 25000, 0)
    assert a.heat_index_f is not None and a.wind_chill_f is None
    b = g["split"]
    assert (b.wind_dir_degrees, b.wind_variable, b.wind_u_kt, b.visibility_sm, b.temp_c, b.dewpoint_c) == (None, 1, None, 1.5, -1.0, -5.0)
    assert (b.wx_ts, b.wx_ra, b.wx_br, b.wx_sn, b.wx_token_count, b.lowest_ceiling_ft) == (1, 1, 1, 0, 2, 200)
    c = g["odd"]
    assert (c.wind_speed_kt, c.wind_variable, c.visibility_sm, c.temp_c, c.cloud_layer_count, c.cloud_cover_max, c.lowest_cloud_base_ft) == (0.0, 0, None, None, 2, 2, None)
    assert c.sea_level_pressure_hpa == 998.7
    d = g["later"]
    assert (d.wind_dir_degrees, d.visibility_sm, d.temp_c, d.dewpoint_c) == (200.0, 3.0, 20.0, 15.0)
    e = g["bare"]
    assert e.wind_speed_kt is None and e.cloud_layer_count is None and e.wx_token_count == 0 and e.visibility_sm is None
    f = g["cloudy"]
    assert (f.cloud_layer_count, f.lowest_ceiling_ft, f.temp_c, f.dewpoint_c) == (2, 800, -5.0, None)


def test_temperature_rules(spark):
    cases = {
        "Between 90-91°F?": (90.0, 91.0, "F"), "72–73°F": (72.0, 73.0, "F"), "Will it be 95°F or higher?": (95.0, None, "F"),
        "20°C or below": (None, 20.0, "C"), "exactly 21 celsius": (21.0, 21.0, "C"), "from 5 to -3 C": (-3.0, 5.0, "F"), "no number": (None, None, "F"),
        "9 degrees c - 8": (9.0, 9.0, "C"), "70 -71": (70.0, 71.0, "F"), "between 70 and -71": (-71.0, 70.0, "F"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", K.temperature_rule(F.col("t"), F.lit("F")).alias("r"))
    assert {r.t: tuple(r.r) for r in df.collect()} == cases


@pytest.mark.parametrize("day", ["2024-03-10", "2024-11-03"])
def test_clock_changes(spark, day):
    """The label groups 23 or 25 hours of a local day; lags count real hours."""
    start = dt.datetime.fromisoformat(day) + dt.timedelta(hours=5)
    rows = [("KDEN", "America/Denver", i, start + dt.timedelta(hours=i), f"KDEN X RMK T0{i:03d}0000") for i in range(30)]
    df = spark.createDataFrame(rows, "station string, tz string, seq long, valid_utc timestamp, metar string")
    days = {str(r.local_date): r.reports for r in O.daily_highs(df).collect()}
    # 30 hourly rows start at 05:00 UTC: local 22:00 the day before in March, 23:00 in November.
    before = 2 if day.startswith("2024-03") else 1
    assert days[day] == (23 if day.startswith("2024-03") else 25) and min(days.values()) >= 1
    assert sum(days.values()) == 30 and sorted(days.items())[0][1] == before
    s = O.with_local_date(df).withColumns({"epoch": F.unix_seconds("valid_utc"), "temp_f": F.col("seq").cast("double"), "is_extra": F.lit(False)})
    lag = {r.seq: r.lag_1h for r in O.series_features(s, lag_hours=1, block=4 * 3600).select("seq", "lag_1h").collect()}
    assert lag == {i: (None if i == 0 else float(i - 1)) for i in range(30)}


def test_slot_snap_wraps_midnight(spark):
    rows = [("A", i, i, 12, 53) for i in range(5)] + [("A", 10, 10, 0, 5), ("A", 11, 11, 23, 59), ("A", 12, 12, 6, 38), ("A", 13, 13, 23, 10)]
    df = spark.createDataFrame(rows, "station string, epoch long, seq long, local_hour int, local_minute int")
    got = {r.seq: (r.scheduled_local_hour, r.scheduled_local_minute) for r in E.snap_to_schedule(df).collect()}
    assert got[10] == (23, 53) and got[11] == (23, 53) and got[12] == (6, 23) and got[13] == (23, 23)


def test_year_blocks():
    assert S.year_blocks(range(2000, 2010), 2009, 3) == [(2009, [2006, 2007, 2008]), (2005, [2002, 2003, 2004])]
    assert len(S.year_blocks(range(2000, 2010), 2009, 3, single=True)) == 1
    with pytest.raises(ValueError):
        S.year_blocks([2001, 2009], 2009, 3)


def test_score_floor(spark):
    r = one(spark, F.greatest(F.lit(91.8138), F.lit(91.94)))[0]
    assert r == 91.94


def test_deep_and_quoted_messages_lose_no_price(spark):
    import json

    from skytally.functions.messages import price_rows

    row = {"event_type": "last_trade_price", "asset_id": "a", "price": "0.5"}
    def deep(n):
        out = row
        for _ in range(n):
            out = {"data": out}
        return json.dumps(out)
    messages = [(n, deep(n)) for n in (0, 3, 6, 9, 14)] + [(20, json.dumps([json.dumps(row)])), (21, "no json"), (22, None)]
    out = price_rows(spark.createDataFrame(messages, "seq int, message string"))
    assert sorted((r["seq"], r["price"]) for r in out.collect()) == [(n, 0.5) for n in (0, 3, 6, 9, 14, 20)]


def test_events_without_a_name_stay_apart(spark):
    from skytally.sources.readers import parse_events

    payload = '[{"title":"x","markets":[{"id":"1"}]},{"title":"y","markets":[{"id":"2"}]}]'
    out = parse_events(spark.createDataFrame([(payload, 0), (payload, 1)], "payload string, page int"))
    assert sorted((r["title"], r["market_id"]) for r in out.collect()) == [("x", "1"), ("x", "1"), ("y", "2"), ("y", "2")]
