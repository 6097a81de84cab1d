"""Keyed stateful jobs on ``transformWithStateInPandas``.

State per key is small: one book's levels, one window's base price, the last five seconds of prints, one
order's totals. One trigger's rows of a key are sorted by arrival and folded in order, so memory per key is
bounded by the trigger: set ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger`` on the source. Keys spread over
the partitions. Whole histories belong to the batch twins, which split a busy key over many tasks.
Needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """One trigger's rows of one key, in arrival order. A trigger is bounded by the source's rate options."""
    parts = list(rows)
    df = pd.concat(parts) if parts else pd.DataFrame()
    return df.sort_values(list(by)) if len(df) else df


class Book(StatefulProcessor):
    """Book per token: ``book`` messages replace it, level changes upsert, size zero deletes, quotes in a
    message override the top. Input: token, seq, kind ('book_start' | 'level' | 'quote'), side, price, size,
    best_bid, best_ask."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.quote = handle.getValueState("quote", "bid double, ask double")

    def _top(self):
        bid = ask = None
        for (side, price), _ in self.levels.iterator():
            if side == "bid":
                bid = price if bid is None else max(bid, price)
            else:
                ask = price if ask is None else min(ask, price)
        return bid, ask

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _sorted(rows, "seq")
        bid, ask = (self.quote.get() if self.quote.exists() else (None, None))
        dirty = False
        for r in df.itertuples(index=False):
            if r.kind == "book_start":
                self.levels.clear()
                dirty = True
            elif r.kind == "level":
                k = (r.side, round(r.price, 4))
                if r.size > 0:
                    self.levels.updateValue(k, (float(r.size),))
                elif self.levels.containsKey(k):
                    self.levels.removeKey(k)
                dirty = True
            else:
                if dirty:
                    bid, ask = self._top()
                    dirty = False
                bid = float(r.best_bid) if pd.notna(r.best_bid) else bid
                ask = float(r.best_ask) if pd.notna(r.best_ask) else ask
        if dirty:
            bid, ask = self._top()
        self.quote.update((bid, ask))
        count = sum(1 for _ in self.levels.iterator())
        yield pd.DataFrame({"token": [key[0]], "seq": [int(df["seq"].max())], "best_bid": [bid], "best_ask": [ask], "levels": [count]})

    def close(self) -> None:
        pass


BOOK_OUT = "token string, seq long, best_bid double, best_ask double, levels int"


class Momentum(StatefulProcessor):
    """First rise of an (asset, field) to its target in a report window. Input rows carry expected_epoch when
    the tick lies in a window (null otherwise), us, seq, price."""

    def __init__(self, fraction: float = 0.3, max_price: float = 1.0):
        self.fraction, self.max_price = min(1.0, max(0.0, fraction)), max_price

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")
        self.window = handle.getValueState("window", "expected long, base double, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _sorted(rows, "us", "seq")
        previous = self.last.get()[0] if self.last.exists() else None
        window = list(self.window.get()) if self.window.exists() else [None, None, True]
        out = []
        for r in df.itertuples(index=False):
            rising = previous is not None and r.price > previous and r.price <= self.max_price
            if pd.notna(r.expected_epoch) and rising:
                if window[0] != int(r.expected_epoch):
                    window = [int(r.expected_epoch), previous, False]
                base = min(0.999999, max(0.0, window[1]))
                if not window[2] and r.price >= base + self.fraction * (1.0 - base):
                    window[2] = True
                    out.append((*key, window[0], window[1], int(r.us), int(r.seq), float(r.price)))
            if r.price > 0:
                previous = float(r.price)
        if previous is not None:
            self.last.update((previous,))
        if window[0] is not None:
            self.window.update(tuple(window))
        if out:
            yield pd.DataFrame(out, columns=["asset", "field", "expected_epoch", "base_price", "us", "seq", "price"])

    def close(self) -> None:
        pass


MOMENTUM_OUT = "asset string, field string, expected_epoch long, base_price double, us long, seq long, price double"


class Flow(StatefulProcessor):
    """Trailing means and taker flow per symbol over a buffer that drops rows older than the longest look."""

    def __init__(self, looks: dict[str, int], flow: int):
        self.looks, self.flow = looks, flow
        self.keep = max([flow, *looks.values()])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "us long, price double, buy double, sell double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _sorted(rows, "us", "seq")
        old = pd.DataFrame(list(self.buffer.get()) if self.buffer.exists() else [], columns=["us", "price", "buy", "sell"])
        fresh = pd.DataFrame({"us": new["us"], "price": new["price"], "buy": new["qty"].where(~new["buyer_maker"], 0.0), "sell": new["qty"].where(new["buyer_maker"], 0.0)})
        both = pd.concat([old, fresh]) if len(old) else fresh
        us = both["us"].to_numpy(dtype="int64")
        sums = {c: both[c].to_numpy(dtype="float64").cumsum() for c in ("price", "buy", "sell")}
        at = lambda c, i: 0.0 if i == 0 else sums[c][i - 1]
        n0, out = len(old), []
        for i, r in enumerate(new.itertuples(index=False), start=n0):
            end = int(us.searchsorted(r.us, side="right"))
            row = [key[0], int(r.seq)]
            for look in self.looks.values():
                start = int(us.searchsorted(r.us - look, side="right"))
                row.append(r.price - (at("price", end) - at("price", start)) / (end - start))
            start = int(us.searchsorted(r.us - self.flow, side="left"))
            row += [at("buy", end) - at("buy", start), at("sell", end) - at("sell", start)]
            out.append(row)
        live = both[us > us[-1] - self.keep - 1]
        self.buffer.put([tuple(x) for x in live[["us", "price", "buy", "sell"]].itertuples(index=False)])
        yield pd.DataFrame(out, columns=["asset", "seq", *[f"delta_{n}" for n in self.looks], "taker_buy_qty", "taker_sell_qty"])

    def close(self) -> None:
        pass


def flow_schema(looks) -> str:
    return "asset string, seq long, " + ", ".join(f"delta_{n} double" for n in looks) + ", taker_buy_qty double, taker_sell_qty double"


class Fills(StatefulProcessor):
    """Increments of cumulative fill reports per order; repeats and falls give nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "shares double, cents long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shares, cents = self.total.get() if self.total.exists() else (0.0, 0)
        out = []
        for r in _sorted(rows, "report_no").itertuples(index=False):
            ds, dc = max(0.0, float(r.cum_shares) - shares), max(0, int(r.cum_cents) - cents)
            shares, cents = max(shares, float(r.cum_shares)), max(cents, int(r.cum_cents))
            if ds > 1e-9 or dc > 0:
                out.append((key[0], int(r.report_no), ds, dc))
        self.total.update((shares, cents))
        if out:
            yield pd.DataFrame(out, columns=["order_id", "report_no", "delta_shares", "delta_cents"])

    def close(self) -> None:
        pass


FILLS_OUT = "order_id long, report_no long, delta_shares double, delta_cents long"


class Capture(StatefulProcessor):
    """Baseline (last known price) at the first tick of a window, then the window's ticks, per (asset, field)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")
        self.window = handle.getValueState("window", "expected long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        price = self.last.get()[0] if self.last.exists() else None
        current = self.window.get()[0] if self.window.exists() else None
        out = []
        for r in _sorted(rows, "us", "seq").itertuples(index=False):
            if pd.notna(r.expected_epoch):
                if int(r.expected_epoch) != current:
                    current = int(r.expected_epoch)
                    if price is not None:
                        out.append((*key, current, "baseline", price, -1))
                out.append((*key, current, "tick", float(r.price), int(r.seq)))
            price = float(r.price)
        if price is not None:
            self.last.update((price,))
        if current is not None:
            self.window.update((current,))
        if out:
            yield pd.DataFrame(out, columns=["asset", "field", "expected_epoch", "kind", "price", "seq"])

    def close(self) -> None:
        pass


CAPTURE_OUT = "asset string, field string, expected_epoch long, kind string, price double, seq long"


class Changes(StatefulProcessor):
    """Station reports whose time or temperature differs from the report before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch long, temp double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = self.last.get() if self.last.exists() else None
        out = []
        for r in _sorted(rows, "epoch", "seq").itertuples(index=False):
            temp = None if pd.isna(r.temp_c) else float(r.temp_c)
            same_temp = was is not None and ((was[1] is None and temp is None) or (was[1] is not None and temp is not None and abs(was[1] - temp) <= 1e-9))
            if was is None or was[0] != int(r.epoch) or not same_temp:
                out.append((key[0], int(r.seq)))
            was = (int(r.epoch), temp)
        if was is not None:
            self.last.update(was)
        if out:
            yield pd.DataFrame(out, columns=["station", "seq"])

    def close(self) -> None:
        pass


CHANGES_OUT = "station string, seq long"


def stateful(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "none")
