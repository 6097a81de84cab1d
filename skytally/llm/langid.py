"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: how often each byte followed each context of up to ``order`` bytes
in its training texts. A byte that a context has not seen escapes to the next shorter context, with escape probability
u / (n + u) for a context of n bytes and u different ones (method C), down to the uniform distribution over bytes. The
statistics are frozen after training, so the code length of a text is a sum over its bytes of a function of the byte and
the ``order`` bytes before it; these are kept as sorted tables, and the language of the shortest code wins.

Training takes at most about ``sample`` texts of each language (a fixed, random-looking choice by hash of the key), which
bounds the model whatever the input. Texts are scored whole, in slices, on one narrow stage without a shuffle.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is everything if there is nothing to
learn from. A null key is neither held out nor learned from. Ties go to the language that sorts first. Repeated rows give
repeated results. Columns other than the key, the text and the language are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import column_types, remainder, texts, with_text

SLICE = 1 << 20
#: The model and its training counts are held whole by each worker, so the number of languages is bounded.
LANGS = 1000


def grams(text: bytes, order: int) -> np.ndarray:
    """For each byte the number made of it and the ``order`` bytes before it; zero bytes stand before the start."""
    codes = np.zeros(len(text) + order, np.int64)
    codes[order:] = np.frombuffer(text, np.uint8)
    out = codes[order:].copy()
    for k in range(1, order + 1):
        out |= codes[order - k : len(codes) - k] << 8 * k
    return out


def count_grams(df: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """Occurrences of each byte with its context by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(name, []).append(grams(t.encode(), order))
            for name, parts in found.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    counted = df.select(text, lang).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths in bits of every byte after every seen context, one column for each language."""

    def __init__(self, counts: pd.DataFrame, order: int):
        self.order, self.langs = order, sorted(counts["lang"].unique())
        column = counts["lang"].map({name: k for k, name in enumerate(self.langs)}).to_numpy()
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        lower = np.full((1, len(self.langs)), 8.0)
        for k in range(order + 1):
            keys, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.zeros((len(keys), len(self.langs)))
            np.add.at(c, (at, column), n)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), c.shape[1])), np.zeros((len(contexts), c.shape[1]))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            escape = np.where(total > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
            below = np.searchsorted(self.keys[-1], keys & ((1 << 8 * k) - 1)) if k else np.zeros(len(keys), np.int64)
            # One language at a time, so that what is computed on the way stays small; the lengths take the counts' place.
            for j in range(len(self.langs)):
                seen = np.log2(np.maximum((total[:, j] + kinds[:, j])[of], 1)) - np.log2(np.maximum(c[:, j], 1))
                c[:, j] = np.where(c[:, j] > 0, seen, escape[of, j] + lower[below, j])
            lower = c
            self.keys.append(keys)
            self.bits.append(lower)
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def code_length(self, text: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        total = np.zeros(len(self.langs))
        for start in range(0, len(text), SLICE):
            before = max(0, start - self.order)
            total += self._bits(grams(text[before : start + SLICE], self.order)[start - before :])
        return total

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.langs))
        for k in range(self.order, -1, -1):
            part = codes & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.keys[k], part), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == part
            total += self.bits[k].T @ np.bincount(at[hit], minlength=len(self.keys[k])) if len(part) > len(self.keys[k]) else self.bits[k][at[hit]].sum(0)
            codes = codes[~hit]
            if not len(codes):
                return total
            context = (codes & ((1 << 8 * (k + 1)) - 1)) >> 8
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            total += self.escapes[k][at[self.contexts[k][at] == context]].sum(0)
        return total + 8.0 * len(codes)


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 3, sample: int = 4000) -> Model | None:
    """Learn from about ``sample`` rows of each language at most; None if no row has a text and a language."""
    rows = df.select(key, text, lang).where(F.col(text).isNotNull() & (F.length(text) > 0) & F.col(lang).isNotNull())
    sizes = rows.groupBy(lang).count().limit(LANGS + 1).collect()
    if len(sizes) > LANGS:
        raise ValueError(f"more than {LANGS} languages: the model has a column for each")
    if not sizes:
        return None
    share = F.pmod(F.xxhash64(F.lit("langid"), F.col(key), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.create_map(*(F.lit(x) for name, n in sizes for x in (name, min(1.0, sample / n))))
    chosen = rows.where(share < wanted[F.col(lang)])
    counts = count_grams(chosen, text, lang, order).toArrow().to_pandas()
    return Model(counts, order) if len(counts) else None


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred, score (posterior probability with equal priors) and bits_per_byte of the prediction."""
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = with_text(df, keep, text, letters.alias("__letters"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*column_types(source.schema.fields[: len(keep)]), "lang_pred string, score double, bits_per_byte double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs, scores, rates = [], [], []
            for value, some in zip(texts(batch, keep, text), batch.column(len(keep))):
                t = value.as_py() if known is not None and some.as_py() else None
                if t is None:
                    langs.append("und"), scores.append(0.0), rates.append(None)
                    continue
                code = t.encode()
                bits = known.code_length(code)
                best = int(bits.argmin())
                langs.append(known.langs[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()))
                rates.append(float(bits[best]) / len(code))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*batch.schema.names[: len(keep)], "lang_pred", "score", "bits_per_byte"])

    return source.mapInArrow(run, schema)


def identify(df: DataFrame, folds: int = 5, order: int = 3, sample: int = 4000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from rows whose key's crc32 modulo ``folds`` is not 0 and predict every row; adds held_out."""
    fold = remainder("doc_id", folds)
    model = train(df.where(fold != 0), order=order, sample=sample)
    held = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return predict(df.select(*(c for c in df.columns if c != "held_out"), held), model, keep=(*keep, "held_out"))
