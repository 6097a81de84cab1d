"""Importance resampling towards a target distribution, drawn by exact ranks of a distributed sort.

Features are runs of one to three words, hashed to buckets by crc32. The logarithm of target share by source share of each
bucket, in thousandths, is an array that every task has; a document's weight is the sum of its features' entries. Noise by
doc_id turns the highest scores into a weighted draw without replacement.

The sort is one by regular sampling: each task sorts its run and writes it with regular samples; splitters are regular
places of all samples; the runs' segments are exchanged and merged segment by segment; rows by segment, summed up, give
the first rank of each segment, and a running count within it the exact rank of each row.

The crc32 of a run of words is put together from those of its words, as crc32 is linear: appending n bytes multiplies by a
fixed matrix over bits, kept as four tables of 256 entries for each n.

Defined results: null and empty texts have no features and weight 0. A row without a doc_id has no noise, so no score and no
place in the draw. Repeated rows take ranks of their own; equal scores and doc_ids order by number of features. Without
documents or without target texts every result is defined by the same formulas, with counts of 0. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.llm.common import column_types, stage

#: Separators become spaces and A-Z a-z; all bytes from 0x80 on are parts of words.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
#: Regular samples of a sorted run, at least; segments then differ from the mean by one part in so many at most.
SAMPLES = 256
#: Words kept by a task before the table begins anew. It bounds memory, not results.
WORDS = 500_000
#: Bytes of text whose words are hashed together.
BLOCK = 4 << 20


def _shift_tables(longest: int) -> np.ndarray:
    """For n zero bytes behind a message: what each byte of its crc32 register becomes. Shape: n + 1, 4, 256."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, longest + 1):
        last = out[n - 1]
        out[n] = step[last & 255] ^ (last >> np.uint32(8))
    return out


class Hashes:
    """crc32 of runs of words. Words longer than ``longest`` bytes have their own tables, made when met."""

    longest = 63

    def __init__(self) -> None:
        self.tables = _shift_tables(self.longest + 1)
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.known, self.size = np.zeros((0, 3), np.int64), 0

    def facts(self, words: list[bytes]) -> np.ndarray:
        """For each word: its crc32, the one of a space and it, and its length."""
        if len(self.words) > WORDS:
            self.clear()
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.fresh:
            new = np.array([(zlib.crc32(w), zlib.crc32(b" " + w), len(w)) for w in self.words.fresh], np.int64)
            if self.size + len(new) > len(self.known):
                self.known = np.concatenate([self.known[: self.size], new, np.zeros((self.size + len(new), 3), np.int64)])
            else:
                self.known[self.size : self.size + len(new)] = new
            self.size += len(new)
            self.words.fresh.clear()
        return self.known[at]

    def append(self, crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
        """crc32 of two strings, from the first's, and the second's and its length."""
        out = np.zeros(len(crc), np.int64)
        for n in np.unique(length[length > self.longest + 1]).tolist():
            some = length == n
            out[some] = _append_long(crc[some], int(n))
        short = length <= self.longest + 1
        if short.all():
            short = slice(None)
        c, n = crc[short], length[short]
        t = self.tables
        out[short] = t[n, 0, c & 255] ^ t[n, 1, c >> 8 & 255] ^ t[n, 2, c >> 16 & 255] ^ t[n, 3, c >> 24]
        return out ^ tail

    def buckets(self, texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all features, the text each is from, and the number of words of each text."""
        split = [t.translate(LETTERS).split() for t in texts]
        counts = np.array([len(x) for x in split], np.int64)
        facts = self.facts([w for x in split for w in x])
        one, spaced, length = facts[:, 0], facts[:, 1], facts[:, 2] + 1
        of = np.repeat(np.arange(len(texts)), counts)
        two = self.append(one[:-1], spaced[1:], length[1:])
        three = self.append(two[:-1], spaced[2:], length[2:])
        second, third = of[:-1] == of[1:], of[:-2] == of[2:]
        features = np.concatenate([one, two[second], three[third]])
        return features % buckets, np.concatenate([of, of[:-1][second], of[:-2][third]]), counts


class _Words(dict):
    """Numbers of words in the order they are met; ``fresh`` has those without hashes yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def _append_long(crc: np.ndarray, n: int) -> np.ndarray:
    """crc32 registers after ``n`` zero bytes, by repeated squaring of the one-byte matrix."""
    columns = _shift_tables(1)[1]
    matrix = [int(columns[b // 8, 1 << b % 8]) for b in range(32)]

    def times(m: list[int], v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for b in range(32):
            out ^= np.where(v >> b & 1, m[b], 0)
        return out

    while n:
        if n & 1:
            crc = times(matrix, crc)
        matrix = times(matrix, np.array(matrix, np.int64)).tolist()
        n >>= 1
    return crc


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch some MB at a time, with the row each block begins at."""
    block, size, first = [], 0, 0
    for n, value in enumerate(column.cast(pa.binary())):
        data = value.as_py() or b""
        block.append(data)
        size += len(data)
        if size >= BLOCK:
            yield first, block
            block, size, first = [], 0, n + 1
    if block:
        yield first, block


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """bucket and n: features of all texts by bucket. A task counts in one array, so at most ``buckets`` rows of it are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = Hashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, block in _blocks(batch.column(0)):
                total += np.bincount(hashes.buckets(block, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return df.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the logarithm of target share by source share of each bucket, one added to every count."""
    s, t = [0] * buckets, [0] * buckets
    for into, counts in ((s, source), (t, target)):
        for row in counts.collect():
            into[row["bucket"]] = row["n"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t))) for a, b in zip(s, t)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_features, weight and n_words of every row. The array of gains goes with the tasks."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, gain = Hashes(), shared.value
        for batch in batches:
            n = batch.num_rows
            features, total, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for first, block in _blocks(batch.column(1)):
                buckets, of, counts = hashes.buckets(block, len(gain))
                at = slice(first, first + len(block))
                features[at] = np.bincount(of, minlength=len(block))
                # Sums of integers below 2 ** 53 are exact in the doubles that bincount adds.
                total[at] = np.bincount(of, gain[buckets], len(block)).astype(np.int64)
                words[at] = counts
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features), pa.array(total), pa.array(words)], ["doc_id", "n_features", "weight", "n_words"])

    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(run, "doc_id long, n_features long, weight long, n_words long")


def with_score(df: DataFrame, seed: int = 42) -> DataFrame:
    """weight and noise by doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return df.withColumn("score", F.col("weight") + noise)


def _samples(runs: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """Regular samples of each run: every 2 ** j-th row, the least j that leaves fewer than 2 * SAMPLES, and that step."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, seen, kept = 1, 0, []
        for batch in batches:
            for at in range(-seen % step, batch.num_rows, 1 if step < 64 else step):
                if (seen + at) % step:
                    continue
                kept.append(tuple(batch.column(c)[at].as_py() for c in range(4)))
                if len(kept) >= 2 * SAMPLES:
                    kept, step = kept[::2], 2 * step
            seen += batch.num_rows
        if kept:
            columns = [pa.array(x, pa.int64()) for x in zip(*kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([step] * len(kept), pa.int64())], ["a", "b", "c", "d", "step"])

    return [tuple(r) for r in runs.select("__a", "doc_id", "n_features", "__row").mapInArrow(sample, "a long, b long, c long, d long, step long").collect()]


def _splitters(samples: list[tuple[int, int, int, int, int]], segments: int) -> list[tuple[int, int, int, int]]:
    """Keys that cut the rows behind the samples into equal segments."""
    samples.sort()
    rows, out, seen = sum(s[4] for s in samples), [], 0
    for *key, step in samples:
        if out and tuple(key) == out[-1]:
            continue
        if seen >= (len(out) + 1) * rows / segments:
            out.append(tuple(key))
        seen += step
    return out


def _segment(df: DataFrame, splitters: list[tuple[int, int, int, int]]) -> DataFrame:
    """The segment of each row: the number of splitters at or before its key."""
    shared = df.sparkSession.sparkContext.broadcast(splitters)
    schema = ", ".join([*column_types(df.schema.fields), "__segment int"])
    at = [df.columns.index(c) for c in ("__a", "doc_id", "n_features", "__row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        firsts = np.array([c[0] for c in cuts], np.int64)
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in at]
            low, high = np.searchsorted(firsts, keys[0], "left"), np.searchsorted(firsts, keys[0], "right")
            for n in np.flatnonzero(low != high).tolist():
                key = tuple(int(k[n]) for k in keys)
                m = bisect_left(cuts, key, int(low[n]), int(high[n]))
                low[n] = m + (m < len(cuts) and cuts[m] == key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32))], [*batch.schema.names, "__segment"])

    return df.mapInArrow(run, schema)


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of each row by score, highest first, then doc_id and n_features, smallest first; 1, 2, 3 and so on.

    ``rows`` needs long columns score, doc_id and n_features without nulls.
    """
    spark = rows.sparkSession
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__a", "doc_id", "n_features", "__row"]
    numbered = rows.withColumn("__a", -F.col("score")).withColumn("__row", F.monotonically_increasing_id())
    runs = stage(numbered.sortWithinPartitions(*order), "runs")
    dealt = _segment(runs, _splitters(_samples(runs), segments))
    # One row for each segment, whose number does not grow with the rows.
    sizes = sorted((r["__segment"], r["n"]) for r in dealt.groupBy("__segment").agg(F.count("*").alias("n")).collect())
    before = [(k, b) for (k, _), b in zip(sizes, accumulate([0, *(n for _, n in sizes)]))]
    first = F.broadcast(spark.createDataFrame(before, "__segment int, __before long"))
    place = F.row_number().over(Window.partitionBy("__segment").orderBy(*order))
    placed = dealt.withColumn("__place", place).join(first, "__segment")
    return placed.withColumn("rank", F.col("__before") + F.col("__place")).drop("__place", "__before", "__segment", "__a", "__row")


def draw(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``df``.

    Of the rows with a doc_id and ``least_words`` words, floor(percent / 100 of them) have a rank: those with the highest
    scores. ``target`` needs the column ``text`` alone.
    """
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, text, buckets), buckets)
    scored = stage(with_score(weights(df, gain, text, key), seed), "scored")
    fit = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = percent * scored.where(fit).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    order = ranked(scored.where(fit).select(*out)).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return order.unionByName(scored.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))
