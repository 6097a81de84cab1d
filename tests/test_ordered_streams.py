"""Folds in event-time order: the same answer for any triggers, late rows kept apart, state that goes when a key is quiet."""

import pytest
from pyspark.sql import functions as F

from skytally.operators import ticks as T
from skytally.plans import q_streams as Q
from skytally.streaming import jobs as J
from skytally.streaming import ordered as O
from skytally.streaming import stateful as S
from skytally.streaming.replay import replay, slices


def rows(df, *cols):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in df.select(*cols).collect()), key=str)


def test_books_do_not_depend_on_triggers(spark, views):
    """One trigger in order, and many small ones with files in no order at all: every message has the same book."""
    feed = Q.book_feed(views).filter("asset IN ('a0', 'a1')")
    cols = ["asset", "seq", "bid", "ask", "levels"]
    once = O.on_time(replay(feed, "us", lambda s: O.ordered(s, "ts", Q.DELAY, Q.ASSET, O.BookMessages()), "ts", parts=1))
    # A message's rows stay in one file, as they would in a landed message.
    shuffled = feed.repartition(6, F.xxhash64("seq"))
    many = O.on_time(replay(shuffled, "us", lambda s: O.ordered(s, "ts", "3000 days", Q.ASSET, O.BookMessages()), "ts", parts=1, per_trigger=1))
    assert rows(once, *cols) == rows(many, *cols)
    assert once.count() == feed.select("seq").distinct().count()


def test_a_change_that_empties_a_side_keeps_its_price(spark):
    schema = "asset string, us long, seq long, ts timestamp, kind string, side string, price double, size double, best_bid double, best_ask double"
    one = lambda n, kind, side=None, price=None, size=None, bid=None, ask=None: ("t", n * T.SECOND, n, None, kind, side, price, size, bid, ask)
    data = [
        one(1, "book", "bid", 0.4, 5.0), one(1, "book", "ask", 0.6, 5.0), one(2, "change", "bid", 0.41, 2.0), one(3, "change", "bid", 0.41, 0.0), one(4, "change", "bid", 0.4, 0.0),
        one(5, "quote", ask=0.55), one(6, "change", "bid", 0.2, 1.0, bid=0.3), one(7, "book"), one(8, "quote"),
    ]
    feed = spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_micros("us"))
    out = O.on_time(replay(feed, "us", lambda s: O.ordered(s, "ts", "1 second", Q.ASSET, O.BookMessages()), "ts"))
    want = [(1, 0.4, 0.6, 2), (2, 0.41, 0.6, 3), (3, 0.4, 0.6, 2), (4, 0.4, 0.6, 1), (5, 0.4, 0.55, 1), (6, 0.3, 0.6, 2), (7, None, None, 0), (8, None, None, 0)]
    assert rows(out, "seq", "bid", "ask", "levels") == want


def test_late_rows_come_out_and_quiet_state_goes(spark, tmp_path):
    """Emitted and late rows are all rows; the state of a quiet order goes by its timer."""
    S.use_rocksdb(spark)
    schema = "order_id long, us long, seq long, cum_shares double, cum_cents long, ts timestamp"
    land = lambda data: spark.createDataFrame([(*r, None) for r in data], schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    second = T.SECOND

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = J.run_once(O.ordered(stream, "ts", "30 seconds", {"order_id": "long"}, O.OrderFills(600 * second)), f"{tmp_path}/out", f"{tmp_path}/ck")
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1]

    first = [(k, (100 + k) * second, 1, 5.0, 50) for k in range(20)] + [(1, 130 * second, 3, 9.0, 90), (1, 125 * second, 2, 9.0, 90)]
    land(first)
    held = run()
    land([(99, 5000 * second, 1, 1.0, 10)])
    run()
    land([(1, 140 * second, 4, 12.0, 120), (99, 4980 * second, 0, 0.5, 5)])
    after = run()
    assert after < held / 3
    out = spark.read.parquet(f"{tmp_path}/out")
    assert rows(O.late_rows(out), "order_id", "seq") == [(1, 4)]
    assert rows(O.on_time(out).filter("order_id = 1"), "seq", "delta_shares", "delta_cents") == [(1, 5.0, 50), (2, 4.0, 40)]
    # The two reports within the last delay still wait; everything else came out once, but for the repeat.
    assert O.on_time(out).count() == 21


def test_flow_takes_a_print_without_a_maker_side(spark):
    schema = "asset string, us long, seq long, ts timestamp, price double, qty double, buyer_maker boolean"
    data = [("a", n * T.SECOND, n, None, float(n), 1.0, [None, True, False][n % 3]) for n in range(6)]
    feed = spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_micros("us"))
    flow = O.TradeFlow({"x": 2 * T.SECOND}, 10 * T.SECOND)
    out = O.on_time(replay(feed, "us", lambda s: O.ordered(s, "ts", "1 second", Q.ASSET, flow), "ts", parts=1))
    assert rows(out, "seq", "delta_x", "taker_buy_qty", "taker_sell_qty") == [(0, 0.0, 0.0, 0.0), (1, 0.5, 0.0, 1.0), (2, 0.5, 1.0, 1.0), (3, 0.5, 1.0, 1.0), (4, 0.5, 1.0, 2.0), (5, 0.5, 2.0, 2.0)]


def test_slices_hold_every_row_once(spark):
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), "id")
    parts = slices(df, "k", 4)
    assert sorted(r["id"] for p in parts for r in p.collect()) == list(range(100))


@pytest.mark.parametrize("empty", [O.BookMessages, O.WindowCapture])
def test_empty_streams(spark, empty):
    processor = empty()
    schema = ", ".join(["asset string", "us long", "seq long", "ts timestamp", *(f"{n} {t}" for n, t in processor.fields.items())])
    feed = spark.createDataFrame([], schema)
    assert replay(feed, "us", lambda s: O.ordered(s, "ts", "1 second", Q.ASSET, processor), "ts", parts=1).count() == 0
