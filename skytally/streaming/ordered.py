"""Keyed stateful jobs that fold rows in event-time order, whatever the triggers.

Rows wait in state until the watermark has passed them. A timer then wakes them, the ready rows of a key are sorted by
(us, rank, seq) and folded, and the answer is the same for one large trigger and for many small ones, with rows out of
order inside the watermark's delay too. Rows older than the watermark when they arrive are not dropped: they come out
with ``late`` set, next to the results, so emitted and late rows are all rows (``on_time``, ``late_rows``).

Keys share state by buckets of their hash, so that a key costs no calls to the state store, each a round trip: a bucket has
one timer, keeps its rows of one delay in chunks, and what each fold needs of its keys in one value, written again when
rows of the bucket come out. A key that is quiet for ``quiet`` loses its part of it by the timer. Needs the RocksDB state
store (``stateful.use_rocksdb``) and a watermark on the stream; the column that carries it is left out before the state,
so that late rows reach it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MS = 1000
#: Event time at which a key without an own end of life is woken.
NEVER = None
#: Buckets of keys. It is part of a checkpoint: a stream goes on with the number it was started with.
BUCKETS = 256
#: Rows of a chunk that goes on waiting.
CHUNK = 50_000
BUCKET = "_bucket"


_KINDS = {"long": int, "int": int, "double": float, "boolean": bool, "string": str}


def _values(column: pd.Series, kind: str) -> list:
    """Plain values of the given type, with None for what is missing; values of other types as they come."""
    make = _KINDS.get(kind, lambda x: x)
    if column.dtype.kind == {int: "i", float: "f", bool: "b"}.get(make) and not column.hasnans:
        return column.tolist()
    return [make(x) if ok else None for x, ok in zip(column, column.notna())]


class Ordered(StatefulProcessor):
    """Base of the folds. ``fields``: further columns of a row with their types; us, rank and seq come first."""

    fields: dict[str, str] = {}
    keys: dict[str, str] = {}
    result: dict[str, str] = {}

    def __init__(self, quiet: int | None = NEVER):
        self.quiet = quiet

    @classmethod
    def schema(cls, key_types: dict[str, str]) -> str:
        return ", ".join(f"{n} {t}" for n, t in {**key_types, "us": "long", "seq": "long", **cls.result, "late": "boolean"}.items())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = {**self.keys, "us": "long", "rank": "int", "seq": "long", **self.fields}
        self.pending = handle.getListState("pending", "chunk binary")
        self.memory = handle.getValueState("memory", "states binary")
        self.wake = handle.getValueState("wake", "ms long")

    def fold(self, state, rows: list[tuple]) -> tuple[object, list[tuple]]:
        """The state after one key's rows (us, rank, seq, fields) in order, and results (us, seq, and the result columns).
        ``state`` is None for a key without one."""
        raise NotImplementedError

    def _out(self, df: pd.DataFrame, late: bool) -> pd.DataFrame:
        return df.reindex(columns=[*self.keys, "us", "seq", *self.result]).assign(late=late)

    def _keep(self, df: pd.DataFrame) -> None:
        for start in range(0, len(df), CHUNK):
            part = df.iloc[start : start + CHUNK]
            self.pending.appendValue((pickle.dumps({c: part[c].to_numpy() for c in part}, pickle.HIGHEST_PROTOCOL),))

    def _wake_at(self, ms: int, was: tuple | None) -> None:
        if was is None or ms < was[0]:
            if was is not None:
                self.handle.deleteTimer(was[0])
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for new in rows:
            new = new.loc[new["us"].notna(), list(self.columns)]
            late = new["us"] // MS < passed
            if late.any():
                yield self._out(new.loc[late, [*self.keys, "us", "seq"]], True)
                new = new[~late]
            if len(new):
                self._keep(new)
                least = int(new["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake_at(first // MS + 1, self.wake.get())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        kept = self.memory.get()
        states = pickle.loads(kept[0]) if kept else {}
        chunks = [pd.DataFrame(pickle.loads(c[0])) for c in self.pending.get()] if self.pending.exists() else []
        rows = pd.concat(chunks, ignore_index=True) if chunks else pd.DataFrame(columns=list(self.columns))
        now = rows["us"].astype("int64") // MS < passed
        ready, rest = rows[now], rows[~now]
        ends, waiting = [], set()
        if len(rest):
            ends.append(int(rest["us"].min()) // MS + 1)
            waiting = set(self._tuples(rest, self.keys))
        if len(ready):
            self.pending.clear()
            self._keep(rest)
            out = self._fold_all(states, ready.sort_values(["us", "rank", "seq"], kind="stable"))
            if out:
                yield self._out(pd.DataFrame(out, columns=[*self.keys, "us", "seq", *self.result]), False)
        held = len(states)
        if self.quiet is not None:
            end_of = {k: (newest + self.quiet) // MS + 1 for k, (newest, _) in states.items() if k not in waiting}
            states = {k: s for k, s in states.items() if end_of.get(k, passed + 1) > passed}
            ends += [end for end in end_of.values() if end > passed]
        if not states:
            if held and kept:
                self.memory.clear()
        elif len(ready) or len(states) < held:
            self.memory.update((pickle.dumps(states, pickle.HIGHEST_PROTOCOL),))
        if ends:
            self._wake_at(min(ends), None)
        else:
            self.wake.clear()

    def _tuples(self, df: pd.DataFrame, columns: dict[str, str]) -> Iterator[tuple]:
        return zip(*[_values(df[c], t) for c, t in columns.items()])

    def _fold_all(self, states: dict, ready: pd.DataFrame) -> list[tuple]:
        """Results of every key's ready rows, with their keys; ``states`` has the newest time and the state by key."""
        of_key, out = {}, []
        rest = {c: t for c, t in self.columns.items() if c not in self.keys}
        for k, row in zip(self._tuples(ready, self.keys), self._tuples(ready, rest)):
            of_key.setdefault(k, []).append(row)
        for k, rows in of_key.items():
            state, made = self.fold(states[k][1] if k in states else None, rows)
            states[k] = (rows[-1][0], state)
            out += [(*k, *r) for r in made]
        return out

    def close(self) -> None:
        pass


class BookMessages(Ordered):
    """Best quotes and level count after every message. A message is one or more rows with the same (us, seq):
    'book' rows replace all levels (one with a null side stands for an empty book), 'change' rows upsert a level or, at
    size 0, delete it, and quotes of a message (best_bid, best_ask) override the top. A side that a change empties keeps
    its last best price; a book without a side has none."""

    fields = {"kind": "string", "side": "string", "price": "double", "size": "double", "best_bid": "double", "best_ask": "double"}
    result = {"bid": "double", "ask": "double", "levels": "int"}

    def fold(self, state, rows: list[tuple]) -> tuple[object, list[tuple]]:
        book, bid, ask = state or ({}, None, None)
        messages, out = {}, []
        for us, _, seq, *row in rows:
            if seq is not None:
                messages.setdefault((us, seq), []).append(row)
        for (us, seq), message in messages.items():
            kinds = {m[0] for m in message}
            if "book" in kinds:
                book.clear()
            for _, side, price, size, _, _ in message:
                price = float("nan") if price is None else price
                if side is not None:
                    if size is not None and size > 0:
                        book[side, price] = size
                    else:
                        book.pop((side, price), None)
            if "book" in kinds or "change" in kinds:
                bids, asks = [p for s, p in book if s == "bid"], [p for s, p in book if s == "ask"]
                bid = max(bids) if bids else None if "book" in kinds else bid
                ask = min(asks) if asks else None if "book" in kinds else ask
            for *_, best_bid, best_ask in message:
                bid = bid if best_bid is None else best_bid
                ask = ask if best_ask is None else best_ask
            out.append((us, seq, bid, ask, len(book)))
        return (book, bid, ask), out


class TradeFlow(Ordered):
    """Price minus its trailing means over (t - look, t], and taker quantities over [t - flow, t], per print."""

    fields = {"price": "double", "qty": "double", "buyer_maker": "boolean"}

    def __init__(self, looks: dict[str, int], flow: int):
        self.looks, self.flow = looks, flow
        super().__init__(quiet=max([flow, *looks.values()]))
        self.result = {**{f"delta_{n}": "double" for n in looks}, "taker_buy_qty": "double", "taker_sell_qty": "double"}

    def schema(self, key_types: dict[str, str]) -> str:
        return ", ".join(f"{n} {t}" for n, t in {**key_types, "us": "long", "seq": "long", **self.result, "late": "boolean"}.items())

    def fold(self, state, rows: list[tuple]) -> tuple[object, list[tuple]]:
        rows = pd.DataFrame(rows, columns=["us", "rank", "seq", *self.fields])
        # A print without a maker side is neither a buy nor a sell.
        maker, qty = rows["buyer_maker"], rows["qty"].astype("float64").fillna(0.0)
        new = pd.DataFrame({"us": rows["us"], "price": rows["price"].astype("float64"), "buy": qty.where(maker.eq(False), 0.0), "sell": qty.where(maker.eq(True), 0.0)})
        both = new if state is None else pd.concat([pd.DataFrame(state), new], ignore_index=True)
        us = both["us"].to_numpy("int64")
        sums = {c: pd.concat([pd.Series([0.0]), both[c].fillna(0.0).cumsum()]).to_numpy() for c in ("price", "buy", "sell")}
        sums["n"] = pd.concat([pd.Series([0]), both["price"].notna().cumsum()]).to_numpy()
        at = rows["us"].to_numpy("int64")
        end = us.searchsorted(at, "right")
        out = rows[["us", "seq"]].copy()
        for name, look in self.looks.items():
            start = us.searchsorted(at - look, "right")
            out[f"delta_{name}"] = new["price"] - (sums["price"][end] - sums["price"][start]) / (sums["n"][end] - sums["n"][start])
        start = us.searchsorted(at - self.flow, "left")
        out["taker_buy_qty"], out["taker_sell_qty"] = sums["buy"][end] - sums["buy"][start], sums["sell"][end] - sums["sell"][start]
        seen = both[us >= us[-1] - self.quiet]
        return {c: seen[c].to_numpy() for c in seen}, list(out.itertuples(index=False, name=None))


class OrderFills(Ordered):
    """Increments of cumulative fill reports over the highest report before; repeats and falls give nothing."""

    fields = {"cum_shares": "double", "cum_cents": "long"}
    result = {"delta_shares": "double", "delta_cents": "long"}

    def fold(self, state, rows: list[tuple]) -> tuple[object, list[tuple]]:
        shares, cents = state or (0.0, 0)
        out = []
        for us, _, seq, cum_shares, cum_cents in rows:
            most_shares, most_cents = max(shares, cum_shares or 0.0), max(cents, cum_cents or 0)
            if most_shares - shares > 1e-9 or most_cents > cents:
                out.append((us, seq, most_shares - shares, most_cents - cents))
            shares, cents = most_shares, most_cents
        return (shares, cents), out


class WindowCapture(Ordered):
    """At the start of a report window the last price of every field of the asset, quiet or not, then the window's ticks.
    Windows are rows of the stream with rank 0 and no field, at the time they start; ticks have rank 1."""

    fields = {"field": "string", "price": "double", "expected_epoch": "long"}
    result = {"field": "string", "expected_epoch": "long", "kind": "string", "price": "double"}

    def __init__(self, length: int = 300, quiet: int | None = NEVER):
        super().__init__(quiet)
        self.length = length

    def fold(self, state, rows: list[tuple]) -> tuple[object, list[tuple]]:
        last, windows = state or ({}, [])
        out = []
        for us, rank, seq, field, price, expected_epoch in rows:
            if rank == 0:
                windows.append(expected_epoch)
                out += [(us, -1, f, expected_epoch, "baseline", p) for f, p in last.items()]
                continue
            windows = [w for w in windows if us < (w + self.length) * 1_000_000]
            out += [(us, seq, field, w, "tick", price) for w in windows]
            last[field] = price
        return (last, windows), out


class DayExtremes(StatefulProcessor):
    """High and low of a station's day after each trigger, from the last report of every observation time.

    Two steps on one key: the last row (by seq) of a time replaces the one before, then high and low come from all
    times, so a correction can lower a high again. ``version`` counts the day's rows; the row with the largest one holds.
    A day's times, a day's minutes at most, are dropped ``keep`` after the last of them; rows older than that are late.
    """

    def __init__(self, keep: int = 36 * 3600 * 1_000_000):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", "epoch long", "seq long, temp double")
        self.about = handle.getValueState("about", "version long, latest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["us"].notna()]
        late = new["us"] + self.keep < timerValues.getCurrentWatermarkInMs() * MS
        if late.any():
            yield pd.DataFrame({"station": key[0], "local_date": key[1], "high": None, "low": None, "latest_epoch": new["us"][late] // 1_000_000, "points": None, "version": None, "late": True})
        new = new[~late]
        if not len(new):
            return
        points = {k[0]: v for k, v in self.points.iterator()}
        version, latest = self.about.get() if self.about.exists() else (0, 0)
        for r in new.sort_values("seq").drop_duplicates("us", keep="last").itertuples(index=False):
            epoch = int(r.us) // 1_000_000
            if epoch not in points or points[epoch][0] < r.seq:
                points[epoch] = (int(r.seq), float(r.temp))
                self.points.updateValue((epoch,), points[epoch])
        latest = max(latest, int(new["us"].max()) // 1_000_000)
        self.about.update((version + len(new), latest))
        self.handle.registerTimer((latest * 1_000_000 + self.keep) // MS + 1)
        temps = [t for _, t in points.values()]
        yield pd.DataFrame({"station": [key[0]], "local_date": [key[1]], "high": [max(temps)], "low": [min(temps)], "latest_epoch": [latest], "points": [len(points)], "version": [version + len(new)], "late": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists() and self.about.get()[1] * 1_000_000 + self.keep < timerValues.getCurrentWatermarkInMs() * MS:
            self.points.clear()
            self.about.clear()
        yield from ()

    def close(self) -> None:
        pass


EXTREMES_OUT = "station string, local_date date, high double, low double, latest_epoch long, points long, version long, late boolean"


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The watermark on ``time``; rows that only move it (a time without a ``seq``) go no further."""
    # The condition names the time, so it is not pushed below the watermark; rows without any time are left out later.
    return stream.withWatermark(time, delay).filter(F.col("seq").isNotNull() | F.col(time).isNull())


def ordered(stream: DataFrame, time: str, delay: str, keys: dict[str, str], processor: Ordered, buckets: int = BUCKETS) -> DataFrame:
    """Fold a stream by key in event-time order. ``keys``: key columns with their types. More ``buckets`` make smaller
    pieces of state, each with its rows of one delay in one task."""
    columns = [*keys, "us", "seq", *processor.fields]
    marked = timed(stream, time, delay)
    rank = F.col("rank") if "rank" in stream.columns else F.lit(0)
    processor.keys = dict(keys)
    rows = marked.select(*columns, rank.cast("int").alias("rank"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET))
    return rows.groupBy(BUCKET).transformWithStateInPandas(processor, processor.schema(keys), "append", "eventTime")


def day_extremes(obs: DataFrame, time: str, delay: str, processor: DayExtremes | None = None) -> DataFrame:
    """``obs``: station, local_date, us, seq and whole_temp with a time column."""
    rows = timed(obs, time, delay).select("station", "local_date", "us", "seq", F.col("whole_temp").cast("double").alias("temp"))
    return rows.groupBy("station", "local_date").transformWithStateInPandas(processor or DayExtremes(), EXTREMES_OUT, "append", "eventTime")


def newest_extremes(out: DataFrame) -> DataFrame:
    """The row of each station and day that holds."""
    rest = ["high", "low", "latest_epoch", "points"]
    picked = out.filter("NOT late").groupBy("station", "local_date").agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return picked.select("station", "local_date", "r.*")


def on_time(out: DataFrame) -> DataFrame:
    return out.filter("NOT late").drop("late")


def late_rows(out: DataFrame) -> DataFrame:
    """Rows that were older than the watermark when they came."""
    return out.filter("late").drop("late")
