"""Quality grades by ordinal cumulative-link regression.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade <= k) = sigmoid(threshold[k] - score). A document is selected by the tail probability of the grade wanted, and its
expected grade is there to rank by. Features are the words that occur and their first four and six bytes (once each), and a few binned shares of the text:
capitals, symbols, repeated lines, different words, length.

The model is fitted to at most about ``sample`` rated documents, a fixed, random-looking choice; the rest of the ratings
only tells how large the choice is. The scores of all documents are one narrow stage without a shuffle.

Defined results: null text, or text without a word, has expected grade 0, probability 0 and is not kept. Without any
rating expected grade and probability are null and everything else is kept. A document rated more than once counts with
its lowest grade; ratings with a null are left out. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from math import isqrt
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import column_types, texts, with_text

BITS = 18
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>!@^~_=+{}[]\\/"
#: ASCII: capitals to lower case, everything that is neither letter nor digit to a space.
PLAIN = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(text: str) -> list[int]:
    """Numbers of the features that a text has; empty for a text without a word."""
    code = text.encode()
    tokens = code.translate(PLAIN).split()
    if not tokens:
        return []
    kinds, lines = set(tokens), [x for x in code.split(b"\n") if x.strip()]
    shares = (
        (len(code.translate(None, CAPITALS)), len(code)),
        (len(code.translate(None, SYMBOLS)), len(code)),
        (len(set(lines)), len(lines)),
    )
    bins = [isqrt(400 * (whole - left) // max(1, whole)) + (whole > left) for left, whole in shares]
    bins += [10 * len(kinds) // len(tokens), len(tokens).bit_length(), 10 * len(kinds) // len(tokens) + 11 * len(tokens).bit_length()]
    mask = (1 << BITS) - 1
    starts = {b"^" + x[:4] for x in kinds} | {b"^" + x[:6] for x in kinds}
    return [*{crc32(x) & mask for x in kinds | starts}, *(crc32(b" %d %d" % x) & mask for x in enumerate(bins))]


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, found: list[int]) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[found].sum(), -500, 500)))


def fit(found: list[np.ndarray], grades: np.ndarray, levels: int, rounds: int = 200, rate: float = 0.05, penalty: float = 0.1, least: int = 5, screen: float = 6.0) -> Model:
    """Adam on the mean negative log likelihood with a squared penalty. Features of fewer than
    ``least`` rows, and those that no grade prefers by ``screen`` standard errors, weigh 0."""
    # Rows by grade and feature, some documents at a time: only what the screening leaves is held as one array.
    by_grade = np.zeros((levels, 1 << BITS), np.int64)
    for k in range(levels):
        own = np.flatnonzero(grades == k)
        for start in range(0, len(own), 500):
            by_grade[k] += np.bincount(np.concatenate([found[i] for i in own[start : start + 500]]), minlength=1 << BITS)
    rows = by_grade.sum(0)
    # Screening: how far the share of lower grades among a feature's rows is from that of all rows, in standard errors.
    marks = np.zeros(1 << BITS)
    for k in range(1, levels):
        p = min(max(float((grades < k).mean()), 1e-6), 1 - 1e-6)
        off = np.abs(by_grade[:k].sum(0) - rows * p)
        marks = np.maximum(marks, off / np.sqrt(np.maximum(rows, 1) * p * (1 - p)))
    chosen = (rows >= least) & (marks >= screen)
    place = np.cumsum(chosen) - 1
    columns = [place[x[chosen[x]]] for x in found]
    of = np.repeat(np.arange(len(found), dtype=np.int32), [*map(len, columns)])
    column = np.concatenate(columns)
    w = np.zeros(int(chosen.sum()))
    share = np.array([(grades < k).mean() for k in range(1, levels)]).clip(0.01, 0.99)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    raw = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    state = np.zeros((2, len(w) + len(raw)))
    for step in range(1, rounds + 1):
        t = np.cumsum(np.concatenate([[raw[0]], np.exp(raw[1:])]))
        s = np.bincount(of, w[column], len(found))
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        upper, lower = 1 / (1 + np.exp(np.clip(s - edge[grades + 1], -500, 500))), 1 / (1 + np.exp(np.clip(s - edge[grades], -500, 500)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gs = (du - dl) / len(s)
        gw = np.bincount(column, gs[of], len(w)) + penalty * w / len(s)
        gt = np.array([(dl[grades == k + 1].sum() - du[grades == k].sum()) / len(s) for k in range(levels - 1)])
        tail = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(raw[1:])])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[: len(w)]
        raw -= move[len(w) :]
    weights = np.zeros(1 << BITS)
    weights[chosen] = w
    return Model(weights, np.cumsum(np.concatenate([[raw[0]], np.exp(raw[1:])])))


def quality_and_toxicity() -> Column:
    """The ratings of the table of labels as grades: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def train(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int = 3, key: str = "doc_id", text: str = "text", sample: int = 10_000) -> Model | None:
    """Fit to about ``sample`` rated documents at most."""
    rated = ratings.select(F.col(key).alias("__key"), grade.cast("int").alias("__grade")).dropna().groupBy("__key").agg(F.min("__grade").alias("__grade"))
    n = rated.count()
    if not n:
        return None
    share = F.pmod(F.xxhash64(F.lit("grade"), "__key"), F.lit(1 << 30)) / float(1 << 30)
    # The choice has about `sample` narrow rows whatever the tables hold.
    chosen = F.broadcast(rated.where(share * n < sample))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull()).join(chosen, "__key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["grade", "found"])

    got = rows.select("__grade", "__text").mapInArrow(run, "grade int, found array<int>").where(F.size("found") > 0).toArrow()
    if not got.num_rows:
        return None
    grades, found = got["grade"].to_numpy(), []
    for lists in got["found"].chunks:
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        found += [flat[a:b] for a, b in zip(ends, ends[1:])]
    # Rows come in any order; sums of floating numbers should not depend on it. Beginnings tell nearly all rows apart.
    order = sorted(range(len(found)), key=lambda k: (grades[k], found[k][:16].tobytes()))
    runs = groupby(order, key=lambda k: (grades[k], found[k][:16].tobytes()))
    order = [k for _, run in runs for k in sorted(run, key=lambda k: found[k].tobytes())]
    model = fit([found[k] for k in order], grades[order], levels)
    del got, grades, found, lists, flat, ends
    pa.default_memory_pool().release_unused()
    return model


def grade_documents(df: DataFrame, model: Model | None, levels: int = 3, wanted: int = 2, least: float = 0.5, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with expected_grade, tail_probability (of ``wanted`` or better) and kept (that is at least ``least``)."""
    source = with_text(df, keep, text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*column_types(source.schema.fields[: len(keep)]), "expected_grade double, tail_probability double, kept boolean"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for value in texts(batch, keep, text):
                found = features(value.as_py() or "")
                if not found:
                    out.append((0.0, 0.0, False))
                elif known is None:
                    out.append((None, None, True))
                else:
                    p = known.above(found)
                    out.append((float(p.sum()), float(p[wanted - 1]), bool(p[wanted - 1] >= least)))
            columns = [*zip(*out)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.float64(), pa.bool_())))], [*batch.schema.names[: len(keep)], "expected_grade", "tail_probability", "kept"])

    return source.mapInArrow(run, schema)
