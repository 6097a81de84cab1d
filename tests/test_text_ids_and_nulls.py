"""Market ids as text break ties as text, whichever way an event is ordered; a null group is a group; the NO floor holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.operators import evaluate as E
from skytally.operators import markets as M
from skytally.operators import scale as X

SCHEMA = "event_id string, market_id string, kind string, unit string, rule_min double, rule_max double, closed boolean, yes_price double, no_price double, observed_high double, observed_low double"


def market(event, kind, ident, lo, hi, high=None, low=None, no=0.5):
    return (event, ident, kind, "F", lo, hi, False, 0.4, no, high, low)


@pytest.fixture(scope="module")
def markets(spark):
    rows = [market(e, k, i, lo, hi) for e, k in (("h", "Highest"), ("l", "Lowest")) for i, lo, hi in (("9", 70.0, 71.0), ("10", 70.0, 71.0), ("3", None, 69.0))]
    return spark.createDataFrame(rows, SCHEMA)


def test_text_ids_tie_as_text(markets):
    got = {(r["event_id"], r["market_id"]): r["position"] for r in M.ordered(markets).collect()}
    assert got == {("h", "3"): 1, ("h", "10"): 2, ("h", "9"): 3, ("l", "9"): 1, ("l", "10"): 2, ("l", "3"): 3}
    edge = {r["event_id"]: r["market_id"] for r in M.outer_boundary(markets).collect()}
    assert edge == {"h": "9", "l": "3"}


def test_nearest_and_harvest_take_text_ids(spark):
    rows = [market("h", "Highest", i, 70.0, 71.0, high=75.0) for i in ("9", "10")] + [market("l", "Lowest", i, 80.0, 81.0, low=70.0) for i in ("9", "10")]
    df = M.in_unit(spark.createDataFrame(rows, SCHEMA))
    near = {r["event_id"]: r["market_id"] for r in M.nearest_no_market(df).collect()}
    assert near == {"h": "10", "l": "10"}
    held = spark.createDataFrame([], "market_id string, side string")
    assert {r["event_id"]: (r["side"], r["market_id"]) for r in M.harvest_plan(df, held).collect()} == {"h": ("NO", "10"), "l": ("NO", "10")}


def test_no_floor(spark):
    rows = [market("h", "Highest", str(k), 60.0 + 2 * k, 61.0 + 2 * k, no=p) for k, p in enumerate((0.01, 0.04, 0.3, 0.6))]
    df = M.in_unit(spark.createDataFrame(rows, SCHEMA))
    pairs = spark.createDataFrame([(1, "h", 0, "2", "3")], "pred_id long, event_id string, matches long, lower_id string, upper_id string")
    held = df.limit(0).select("market_id")
    free = M.pair_plan(pairs, df, held).first()
    assert (free["plan"], free["no_market_id"]) == ("buy_no_elsewhere", "0")
    assert M.pair_plan(pairs, df, held, no_floor=0.02).first()["no_market_id"] == "1"
    assert M.pair_plan(pairs, df, held, no_floor=0.05).first()["plan"] != "buy_no_elsewhere"


def test_a_null_group_keeps_its_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k % 3 == 0 else f"s{k % 3}", float(x)) for k, x in enumerate(rng.normal(0, 2, 900))]
    df = spark.createDataFrame(rows, "station string, error_f double")
    report = {r["station"]: r for r in E.error_report(df, ["station"]).collect()}
    plain = {r["s"]: r["p50"] for r in X.exact_percentiles(df.select(F.col("station").alias("s"), "error_f"), ["s"], "error_f", {"p50": 0.5}, 0.05).collect()}
    assert len(report) == len(plain) == 3
    for name in (None, "s1", "s2"):
        part = np.array([x for s, x in rows if s == name])
        assert report[name]["p90_abs_error_f"] == pytest.approx(np.quantile(np.abs(part), 0.9))
        assert plain[name] == pytest.approx(np.quantile(part, 0.5))
