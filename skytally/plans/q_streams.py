"""Streams as queries: a whole view is replayed in slices, the job restarted after each, and what it wrote is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally.functions.units import c_to_f, half_even, tidy
from skytally.operators import ticks as T
from skytally.operators.observations import with_local_date
from skytally.plans import q_ledger, q_ticks
from skytally.plans.registry import ORACLE, query, r
from skytally.streaming import ordered as O
from skytally.streaming.replay import replay

ASSET = {"asset": "string"}
DELAY = "30 seconds"


def book_feed(v):
    """Every tick as a message: snapshots, level changes with deletions, and quotes that override."""
    level = lambda side, price, size: F.struct(F.lit(side).alias("side"), price.alias("price"), size.alias("size"))
    p, s = F.floor(F.col("price") * 10) / 10.0, F.col("seq")
    book = F.array(level("bid", p, F.col("qty") + 1), level("bid", p - 0.25, F.col("qty") + 2), level("ask", p + 0.25, F.col("qty") + 1))
    side = F.when(s % 2 == 0, "bid").otherwise("ask")
    change = F.array(F.struct(side.alias("side"), p.alias("price"), F.when(s % 3 == 0, 0.0).otherwise(F.col("qty") + 1).alias("size")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("size")))
    kind = F.when(s % 12 == 0, "book").when(s % 12 == 5, "quote").otherwise("change")
    feed = v.ticks.select(
        "asset", "us", "seq", "ts", kind.alias("kind"), F.when(s % 5 == 1, F.col("price")).alias("best_bid"), F.when(s % 7 == 2, F.col("price") + 0.5).alias("best_ask"),
        F.explode(F.when(kind == "book", F.when(s % 24 == 0, none).otherwise(book)).when(kind == "quote", none).otherwise(change)).alias("l"))
    return feed.select("asset", "us", "seq", "ts", "kind", "l.*", "best_bid", "best_ask")


@query(
    "str2_stream_book", "ticks",
    """, m AS (
  SELECT asset, us, seq, floor(price * 10) / 10.0e0 AS p, qty, CASE WHEN seq % 12 = 0 THEN 'book' WHEN seq % 12 = 5 THEN 'quote' ELSE 'change' END AS kind,
    CASE WHEN seq % 5 = 1 THEN price END AS qb, CASE WHEN seq % 7 = 2 THEN price + 0.5e0 END AS qa, row_number() OVER (PARTITION BY asset ORDER BY us, seq) AS o FROM ticks
), l AS (
  SELECT asset, o, 'bid' AS side, p AS price, qty + 1 AS size FROM m WHERE kind = 'book' AND seq % 24 <> 0
  UNION ALL SELECT asset, o, 'bid', p - 0.25e0, qty + 2 FROM m WHERE kind = 'book' AND seq % 24 <> 0
  UNION ALL SELECT asset, o, 'ask', p + 0.25e0, qty + 1 FROM m WHERE kind = 'book' AND seq % 24 <> 0
  UNION ALL SELECT asset, o, CASE WHEN seq % 2 = 0 THEN 'bid' ELSE 'ask' END, p, CASE WHEN seq % 3 = 0 THEN 0 ELSE qty + 1 END FROM m WHERE kind = 'change'
), e AS (SELECT *, lead(o) OVER (PARTITION BY asset, side, price ORDER BY o) AS next FROM l),
b AS (SELECT asset, o, min(CASE WHEN kind = 'book' THEN o END) OVER (PARTITION BY asset ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cleared FROM m),
a AS (SELECT e.asset, e.side, e.price, e.o, least(coalesce(e.next, 1e18), coalesce(b.cleared, 1e18)) AS until FROM e JOIN b ON b.asset = e.asset AND b.o = e.o WHERE e.size > 0),
t AS (
  SELECT m.asset, m.o, max(CASE WHEN side = 'bid' THEN price END) AS tb, min(CASE WHEN side = 'ask' THEN price END) AS ta, count(a.price) AS levels
  FROM m LEFT JOIN a ON a.asset = m.asset AND a.o <= m.o AND m.o < a.until GROUP BY 1, 2
), s AS (
  SELECT m.*, levels,
    CASE WHEN qb IS NOT NULL THEN {'v': qb} WHEN kind = 'book' OR (kind = 'change' AND tb IS NOT NULL) THEN {'v': tb} END AS sb,
    CASE WHEN qa IS NOT NULL THEN {'v': qa} WHEN kind = 'book' OR (kind = 'change' AND ta IS NOT NULL) THEN {'v': ta} END AS sa
  FROM m JOIN t ON t.asset = m.asset AND t.o = m.o
) SELECT asset, seq, """ + r("(last_value(sb IGNORE NULLS) OVER w).v") + " AS bid, " + r("(last_value(sa IGNORE NULLS) OVER w).v") + """ AS ask, CAST(levels AS INT) AS levels FROM s
  WINDOW w AS (PARTITION BY asset ORDER BY o)""",
)
def str2(v):
    out = replay(book_feed(v), "us", lambda s: O.ordered(s, "ts", DELAY, ASSET, O.BookMessages()), "ts")
    return O.on_time(out).select("asset", "seq", tidy(F.col("bid")).alias("bid"), tidy(F.col("ask")).alias("ask"), "levels")


def capture_feed(v):
    """Ticks and the starts of report windows in one stream."""
    t = v.ticks.select("asset", "us", F.lit(1).alias("rank"), "seq", "ts", "field", "price", F.lit(None).cast("long").alias("expected_epoch"))
    e = F.col("expected_epoch")
    w = q_ticks._windows(v).select(
        "asset", (e * T.SECOND).alias("us"), F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("seq"), F.timestamp_seconds(e).alias("ts"),
        F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("price"), e.cast("long").alias("expected_epoch"))
    return t.unionByName(w)


@query("str4_stream_capture", sql=ORACLE["str4_window_capture"])
def str4(v):
    out = replay(capture_feed(v), "us", lambda s: O.ordered(s, "ts", DELAY, ASSET, O.WindowCapture(300)), "ts")
    return O.on_time(out).select("asset", "field", "expected_epoch", "kind", "price", "seq")


@query(
    "str7_stream_extremes", "obs",
    f", c AS (SELECT *, CASE WHEN seq % 5 = 0 THEN tenths - 150 ELSE tenths END AS t10 FROM obs WHERE tenths IS NOT NULL UNION ALL SELECT *, tenths FROM obs WHERE tenths IS NOT NULL AND seq % 3 = 0), x AS (SELECT *, seq * 2 + CASE WHEN t10 = tenths AND seq % 3 = 0 THEN 1 ELSE 0 END AS s2 FROM c),"
    f" p AS (SELECT station, CAST({q_ticks.SQL_LOCAL} AS DATE) AS local_date, epoch, arg_max(CAST(round_even(t10 / 10.0e0 * 9.0e0 / 5.0e0 + 32.0e0, 0) AS BIGINT), s2) AS t FROM x GROUP BY 1, 2, 3)"
    " SELECT station, local_date, CAST(max(t) AS DOUBLE) AS high, CAST(min(t) AS DOUBLE) AS low, max(epoch) AS latest_epoch, count(*) AS points FROM p GROUP BY 1, 2",
)
def str7(v):
    return O.newest_extremes(replay(corrected_obs(v), "seq", lambda s: O.day_extremes(s, "valid_utc", "10 days"), "valid_utc"))


def corrected_obs(v):
    """Reports of which every fifth is too low by 15 degrees, and a third come again as they should be, up or down."""
    obs = with_local_date(v.obs.filter("tenths IS NOT NULL"))
    temp = lambda t: half_even(c_to_f(t / 10.0))
    wrong = F.when(F.col("seq") % 5 == 0, F.col("tenths") - 150).otherwise(F.col("tenths"))
    cols = ["station", "local_date", (F.col("epoch") * T.SECOND).alias("us"), "valid_utc"]
    # A report that was right and comes again counts as the same row: its number is the later one.
    first = obs.select(*cols, (F.col("seq") * 2 + F.when((F.col("seq") % 5 != 0) & (F.col("seq") % 3 == 0), 1).otherwise(0)).alias("seq"), temp(wrong).alias("whole_temp"))
    again = obs.filter("seq % 3 = 0").select(*cols, (F.col("seq") * 2 + 1).alias("seq"), temp(F.col("tenths")).alias("whole_temp"))
    return first.unionByName(again)


@query("str9_stream_flow", sql=ORACLE["win9_win10_trailing_flow"])
def str9(v):
    """The prints land out of order: within two minutes they are shuffled, the watermark's delay is five."""
    looks = {n: s * T.SECOND for n, s in q_ticks.LOOKS.items()}
    flow = O.TradeFlow(looks, 30000 * T.SECOND)
    feed = v.ticks.select("asset", "us", "seq", "ts", "price", "qty", "buyer_maker", (F.col("us") + F.pmod(F.xxhash64("seq"), F.lit(120 * T.SECOND))).alias("arrival"))
    out = replay(feed, "arrival", lambda s: O.ordered(s, "ts", "5 minutes", ASSET, flow), "ts")
    return O.on_time(out).select("seq", *[tidy(F.col(c)).alias(c) for c in flow.result])


@query(
    "str10_stream_fills", sql="SELECT order_id, report_no, delta_shares, delta_cents FROM (" + ORACLE["win16_fill_increments"] + ") WHERE delta_shares > 0 OR delta_cents > 0",
)
def str10(v):
    """Reports of an order are a minute apart; an order that is quiet for ten loses its state."""
    made = (F.floor(F.col("report_no") / 1_000_000) * 60 + F.col("order_id") % 100_000).cast("long")
    feed = v.fill_reports.select("order_id", (made * T.SECOND).alias("us"), F.timestamp_seconds(made).alias("ts"), F.col("report_no").alias("seq"), "cum_shares", F.col("cum_cents").cast("long").alias("cum_cents"))
    out = replay(feed, "us", lambda s: O.ordered(s, "ts", DELAY, {"order_id": "long"}, O.OrderFills(600 * T.SECOND)), "ts")
    return O.on_time(out).select("order_id", F.col("seq").alias("report_no"), "delta_shares", "delta_cents")
