"""Folds of many keys and many messages: no state of its own for each key, no table operation for each message."""

import time

from pyspark.sql import functions as F

from skytally.operators import ticks as T
from skytally.streaming import jobs as J
from skytally.streaming import ordered as O
from skytally.streaming import stateful as S


def test_orders_share_state(spark, tmp_path):
    """3000 orders with a report each hold a few state rows a bucket, and every order has its own total."""
    S.use_rocksdb(spark)
    schema = "order_id long, us long, seq long, cum_shares double, cum_cents long, ts timestamp"

    def run(rows):
        rows.select(*[F.expr(f"CAST({e} AS {t}) AS {c}") for c, e, t in zip(("order_id", "us", "seq", "cum_shares", "cum_cents", "ts"), ("k", "us", "n", "k % 7 + n", "0", "timestamp_micros(us)"), ("long", "long", "long", "double", "long", "timestamp"))]).write.mode("append").parquet(f"{tmp_path}/in")
        q = J.run_once(O.ordered(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "30 seconds", {"order_id": "long"}, O.OrderFills(600 * T.SECOND), buckets=8), f"{tmp_path}/out", f"{tmp_path}/ck")
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1]

    for n in (1, 2):
        assert run(spark.range(3000).selectExpr("id AS k", f"{n}L AS n", f"{n * 100 * T.SECOND}L AS us")) <= 8 * 10
    run(spark.range(1).selectExpr("-1L AS k", "3L AS n", f"{100_000 * T.SECOND}L AS us"))
    got = O.on_time(spark.read.parquet(f"{tmp_path}/out")).groupBy("seq").agg(F.count("*"), F.sum("delta_shares")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(1, 3000, 3000.0 + sum(k % 7 for k in range(3000))), (2, 3000, 3000.0)]


def test_many_messages_fold_fast():
    rows = [(n, 0, n, "change", "bid" if n % 2 else "ask", (n % 40) / 40.0, float(n % 3), None, None) for n in range(60_000)]
    at = time.process_time()
    state, out = O.BookMessages().fold(None, rows)
    assert time.process_time() - at < 10
    book = {}
    for _, _, seq, _, side, price, size, *_ in rows[:200]:
        book.pop((side, price), None)
        book.update({(side, price): size} if size else {})
        assert out[seq][4] == len(book)
    assert len(out) == 60_000 and len(state[0]) == out[-1][4]


def test_many_windows_fold_fast():
    second = T.SECOND
    rows = [(n * second, 0, -1, None, None, n) if n % 600 == 0 else (n * second, 1, n, f"f{n % 3}", n / 10.0, None) for n in range(60_000)]
    at = time.process_time()
    _, out = O.WindowCapture(300).fold(None, rows)
    assert time.process_time() - at < 10
    assert sum(r[4] == "tick" for r in out) == 100 * 299
    assert sorted(r for r in out if r[4] == "baseline" and r[3] == 600) == [(600 * second, -1, f"f{k}", 600, "baseline", (597 + k) / 10.0) for k in range(3)]
