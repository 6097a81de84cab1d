"""Blocked operators equal the plain whole-key computation, also on hot keys, copies, ties and nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.operators import observations as O
from skytally.operators import scale as X


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}"
        rows.append((key, rnd.randrange(0, 20000), i, None if rnd.random() < 0.2 else rnd.randrange(100) / 4.0))
    rows += [("hot", 777, 5000 + i, 3.0) for i in range(1000)]  # one instant with many copies
    return spark.createDataFrame(rows, "k string, t long, seq long, v double").cache()


def same(a, b, *cols):
    fix = lambda r: tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(fix, a.select(*cols).collect()), key=str) == sorted(map(fix, b.select(*cols).collect()), key=str)


def test_running_equals_window(series):
    specs = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")),
             "la": ("last", F.col("v")), "fi": ("first", F.col("v")), "prev": ("last", F.struct("v"), True), "nx": ("next", F.col("v"))}
    got = X.running(X.with_block(series, "t", 500), ["k"], [X.BLOCK], ["t", "seq"], specs).withColumn("prev", F.col("prev.v"))
    ahead = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(0, Window.unboundedFollowing)
    w = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = series.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"),
                         F.last("v", True).over(w).alias("la"), F.first("v", True).over(w).alias("fi"), F.lag("v").over(Window.partitionBy("k").orderBy("t", "seq")).alias("prev"), F.first("v", True).over(ahead).alias("nx"))
    same(got, want, "seq", "s", "n", "hi", "lo", "la", "fi", "prev", "nx")


def test_running_without_keys(series):
    got = X.running(X.with_block(series, "t", 500), [], [X.BLOCK], ["t", "seq"], {"s": ("sum", F.col("v"))})
    w = Window.orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    same(got, series.select("*", F.sum("v").over(w).alias("s")), "seq", "s")


def test_lookback_equals_window(series):
    f = lambda w: F.sum("v").over(w.orderBy("t").rangeBetween(-300, 0)).alias("s")
    got = X.lookback(series, "t", 300, 400).select("*", f(Window.partitionBy("k", X.BLOCK))).filter(X.CORE)
    same(got, series.select("*", f(Window.partitionBy("k"))), "seq", "s")


def test_asof_equals_pandas(spark, series):
    right = series.filter("v IS NOT NULL AND seq % 9 = 0").groupBy("k", "t").agg(F.max_by("v", "seq").alias("v"))
    left = series.filter("seq % 7 = 1").select("k", F.col("t").alias("lt"), "seq")
    got = {r.seq: r.asof_v for r in X.asof(left, right, ["k"], "lt", "t", ["v"], 700).collect()}
    r = right.toPandas()
    for row in left.collect():
        c = r[(r.k == row.k) & (r.t <= row.lt)].sort_values("t")
        assert got[row.seq] == (c.v.iloc[-1] if len(c) else None)
    firsts = X.asof(left, right, ["k"], "lt", "t", ["v"], 700, first_too=True)
    assert firsts.filter("asof_v IS NULL").count() == 0 and firsts.count() == left.count()


@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
def test_percentiles_equal_numpy(series, width):
    probs = {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in X.exact_percentiles(series, ["k"], "v", probs, width).collect()}
    for k, part in series.filter("v IS NOT NULL").toPandas().groupby("k"):
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(part.v, p), abs=1e-9)


def test_top_and_latest(series):
    top = X.top_rows(series.filter("v IS NOT NULL"), ["k"], [F.desc("v"), F.col("seq")], 3)
    p = series.filter("v IS NOT NULL").toPandas().sort_values(["v", "seq"], ascending=[False, True]).groupby("k").head(3)
    assert sorted(r.seq for r in top.collect()) == sorted(p.seq)
    last = X.latest_by(series, ["k"], [F.col("t"), F.col("seq")], ["v", "seq"])
    q = series.toPandas().sort_values(["t", "seq"]).groupby("k").tail(1)
    assert sorted(r.seq for r in last.collect()) == sorted(q.seq)


def test_features_by_brute_force(spark):
    """Context and lags against a direct loop over one station with duplicates, nulls and gaps."""
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(0, 3 * 86400, 300), i, None if rnd.random() < 0.25 else rnd.randrange(400) / 10, rnd.random() < 0.4) for i in range(400))
    rows = [(e, n, t, x) for n, (e, _, t, x) in enumerate(rows)]
    df = spark.createDataFrame([("S", *r) for r in rows], "station string, epoch long, seq long, temp_f double, is_extra boolean").withColumn("local_date", F.to_date(F.timestamp_seconds("epoch")))
    got = {r.seq: r for r in O.series_features(df, lag_hours=2, block=6 * 3600).collect()}
    for i, (e, n, t, x) in enumerate(rows):
        g = got[n]
        for prefix, keep in (("obs", lambda r: True), ("extra", lambda r: r[3])):
            near = [r for r in rows if e - 21600 <= r[0] <= e and r[2] is not None and keep(r)]
            assert g[f"{prefix}_count"] == len(near)
            if near:
                hi = max(near, key=lambda r: r[2])
                lo = min(near, key=lambda r: r[2])
                assert (g[f"{prefix}_max_temp_f"], g[f"{prefix}_max_temp_minutes_ago"]) == (hi[2], (e - hi[0]) / 60)
                assert (g[f"{prefix}_min_temp_f"], g[f"{prefix}_min_temp_minutes_ago"]) == (lo[2], (e - lo[0]) / 60)
                assert (g[f"{prefix}_latest_temp_f"], g[f"{prefix}_latest_temp_minutes_ago"]) == (near[-1][2], (e - near[-1][0]) / 60)
        for h in (1, 2):
            target = e - h * 3600
            after = next((r for r in rows if r[0] >= target), None)
            before = next((r for r in reversed(rows) if r[0] < target), None)
            best = None
            for c in (after, before):
                if c and c[2] is not None and abs(c[0] - target) <= 1800 and (best is None or abs(c[0] - target) < abs(best[0] - target)):
                    best = c
            assert g[f"lag_{h}h"] == (best[2] if best else None)
