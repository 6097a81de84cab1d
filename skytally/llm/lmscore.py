"""Language-model scores of documents by subword lattices.

The pieces of an existing unigram vocabulary span a lattice over each word, with every byte as a last resort. Their
weights start from the vocabulary's own scores (a piece of rank r weighs 1 / (r + ``offset``)) and are re-estimated once
from the training words: expected counts over all segmentations, by a forward and a backward pass, added to the starting
weights. The score of a text sums, over its words and its end, the marginal log probability of all segmentations, by the
forward recursion in log space. No piece crosses a word, so a text's score is a sum over its words.

Word counts of the corpus are a table with a row for each word, which also holds the word's score: it is made once and
joined. The ``frequent`` most frequent words, a fixed number, are shared with every task, so hot words are never shuffled;
the other words of each document are joined by word.

Defined results: a null text is an empty one and has one token, its end. A null key is neither trained on nor held out.
Repeated rows give repeated results. Without training tokens the base score is log10(1 / 1) per token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import remainder, stage

FLUSH, FREQUENT, BATCH, LONG, BLOCK = 200_000, 100_000, 20_000, 64, 2048


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words are runs of other characters than the six of ASCII white space."""
    return text.encode().lower().split() if text else []


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str | None = None, offset: float = 10.0) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces, with a space for the mark of a word's start, then all bytes; and their weights, of sum 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    scored: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k).replace("▁", " ")
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)) and " " not in piece[1:]:
            scored[piece.lower().encode()] = max(model.get_score(k), scored.get(piece.lower().encode(), -math.inf))
    last = min(scored.values())
    for b in range(256):
        scored.setdefault(bytes([b]), last - 1)
    order = sorted(scored, key=lambda x: (-scored[x], x))
    weights = 1 / (np.arange(len(order)) + offset)
    return order, weights / weights.sum()


class Lattice:
    """Pieces as a byte trie (node by byte), with the log probability of the piece that ends in each node."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        step, ends = [[0] * 256, [0] * 256], []
        for piece in pieces:
            node = 1
            for b in piece:
                if not step[node][b]:
                    step[node][b] = len(step)
                    step.append([0] * 256)
                node = step[node][b]
            ends.append(node)
        self.step, self.ends = np.array(step, np.int32), np.array(ends)
        self.log = np.full(len(step), -np.inf)
        self.log[self.ends] = np.log(weights)

    def spans(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Start, end and nodes of each span of words of one length, by start; rows without a piece have a log of -inf."""
        length = rows.shape[1]
        for i in range(length):
            node = np.ones(len(rows), np.int32)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                node = self.step[node, rows[:, j - 1]]
                if not node.any():
                    break
                yield i, j, node

    def forward(self, rows: np.ndarray) -> np.ndarray:
        alpha = np.full((rows.shape[1] + 1, len(rows)), -np.inf)
        alpha[0] = 0
        for i, j, node in self.spans(rows):
            np.logaddexp(alpha[j], alpha[i] + self.log[node], out=alpha[j])
        return alpha

    def expect(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected number of each piece, by node, in words that occur ``n`` times."""
        alpha, out = self.forward(rows), np.zeros(len(self.log))
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for i, j, node in sorted(self.spans(rows), key=lambda x: -x[0]):
            at = alpha[i] + self.log[node] - alpha[-1]
            part = np.exp(at + beta[j]) * n
            out += np.bincount(node, part, len(out))
            np.logaddexp(beta[i], self.log[node] + beta[j], out=beta[i])
        return out

    def by_length(self, found: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Places and bytes of the words of each length, some thousand words at a time."""
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(found):
            groups.setdefault(len(word), []).append(k)
        for length, places in groups.items():
            most = max(1, BATCH * 10 // length)
            for start in range(0, len(places), most):
                part = places[start : start + most]
                code = b"".join(b" " + found[k] for k in part)
                yield part, np.frombuffer(code, np.uint8).reshape(len(part), length + 1)

    def log10(self, found: list[bytes]) -> np.ndarray:
        """Marginal log10 probability of each word."""
        out = np.zeros(len(found))
        for places, rows in self.by_length(found):
            if rows.shape[1] <= LONG:
                out[places] = self.forward(rows)[-1]
            else:
                out[places] = [self._one(row) for row in rows]
        return out / math.log(10)

    def _block(self, row: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and logs of the pieces of 1, 2, ... bytes (columns) at some thousand positions of one word (rows)."""
        stop = min(len(row), start + BLOCK)
        code, node = np.zeros(stop - start + self.longest, np.intp), np.ones(stop - start, np.int32)
        code[: len(row) - start] = row[start : start + len(code)]
        nodes = np.empty((stop - start, self.longest), np.int32)
        for d in range(self.longest):
            node = self.step[node, code[d : d + stop - start]]
            # A piece does not reach beyond the word.
            node[max(0, len(row) - start - d) :] = 0
            nodes[:, d] = node
        return nodes, self.log[nodes]

    def _along(self, logs: np.ndarray, recent: np.ndarray) -> np.ndarray:
        """Forward values of a block and of the ``longest`` positions behind it; ``recent`` are those known at its start."""
        alpha = np.full(len(logs) + self.longest + 1, -np.inf)
        alpha[: len(recent)] = recent
        for k, log in enumerate(logs):
            part = alpha[k + 1 : k + 1 + self.longest]
            np.logaddexp(part, alpha[k] + log, out=part)
        return alpha

    def _heads(self, row: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Forward values known at the start of each block of one long word, and that of its end."""
        heads = [np.zeros(1)]
        for start in range(0, len(row), BLOCK):
            logs = self._block(row, start)[1]
            heads.append(self._along(logs, heads[-1])[len(logs) :].copy())
        return heads[:-1], float(heads[-1][0])

    def _one(self, row: np.ndarray) -> float:
        """The same for one long word, block by block."""
        return self._heads(row)[1]

    def expect_one(self, row: np.ndarray, n: float, out: np.ndarray) -> None:
        """Adds to ``out`` what ``expect`` gives for one long word: its blocks backwards, forward values made again in each."""
        heads, total = self._heads(row)
        behind = np.full(self.longest, -np.inf)
        behind[0] = 0
        for at in range(len(heads) - 1, -1, -1):
            nodes, logs = self._block(row, at * BLOCK)
            alpha = self._along(logs, heads[at])[: len(logs)]
            beta = np.concatenate([np.empty(len(logs)), behind])
            for k in range(len(logs) - 1, -1, -1):
                beta[k] = np.logaddexp.reduce(logs[k] + beta[k + 1 : k + 1 + self.longest])
            ahead = np.lib.stride_tricks.sliding_window_view(beta[1:], self.longest)
            part = np.exp(alpha[:, None] + logs + ahead - total) * n
            out += np.bincount(nodes.ravel(), part.ravel(), len(out))
            behind = beta[: self.longest].copy()


def count_words(df: DataFrame, text: str = "text", training: str = "training") -> DataFrame:
    """Rows (word, c): occurrences in training rows, 0 for words of other rows only. Counted in each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*seen.keys()], pa.binary()).cast(pa.string()), pa.array([*seen.values()], pa.int64())], ["word", "c"])

        for batch in batches:
            for value, used in zip(batch.column(0), batch.column(1).to_pylist()):
                found = words(value.as_py())
                if used:
                    seen.update(found)
                else:
                    for word in set(found):
                        seen.setdefault(word, 0)
                if len(seen) >= FLUSH:
                    yield flush()
                    seen = Counter()
        if seen:
            yield flush()

    return df.select(text, training).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, pieces: list[bytes], weights: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """Log probability of each piece, and of the end, after one re-estimation from the training words."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        total = np.zeros(len(lattice.log))
        for batch in batches:
            found = [x.encode() for x in batch.column(0).to_pylist()]
            n = np.array(batch.column(1).to_pylist(), np.float64)
            for places, rows in lattice.by_length(found):
                if rows.shape[1] <= LONG:
                    total += lattice.expect(rows, n[places])
                else:
                    for row, times in zip(rows, n[places]):
                        lattice.expect_one(row, times, total)
        got = total[lattice.ends]
        used = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(got[used])], ["piece", "n"])

    found = counts.where("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    expected = np.zeros(len(pieces))
    expected[found["piece"]] = found["n"]
    total = expected.sum() + 1.0 + ends + 1
    return (expected + weights) / total, math.log10((ends + 1) / total)


def word_scores(counts: DataFrame, pieces: list[bytes], weights: np.ndarray) -> DataFrame:
    """``counts`` with ``lp``, the marginal log10 probability of the word."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            lp = lattice.log10([x.encode() for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], ["word", "c", "lp"])

    return counts.select("word", "c").mapInArrow(run, "word string, c long, lp double")


def frequent_words(table: DataFrame, most: int) -> list:
    """At most ``most`` words, all above a count that a histogram of some hundred bins gives; and that count."""
    bins = table.where("c > 0").groupBy(F.floor(8 * F.log2("c")).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect()
    least, room = 1 << 62, most
    for r in sorted(bins, key=lambda x: -x["bin"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    return table.where(F.col("c") >= least).collect() if least < 1 << 62 else [], least


def score(df: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, held: int = 2, vocabulary: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    fold = remainder(key, folds)
    rows = df.select(
        F.col(key).alias("__key"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
        F.coalesce(fold == held, F.lit(False)).alias("__held"),
        F.coalesce(fold != held, F.lit(False)).alias("__train"),
    )
    ends = rows.where("__train").count()
    counts = stage(count_words(rows, "__text", "__train"), "words")
    pieces, weights = load_pieces(vocabulary)
    fitted, end_lp = fit(counts, pieces, weights, ends)
    table = stage(word_scores(counts, pieces, fitted), "word-scores")
    tokens, kinds = table.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    below = math.log10(tokens + kinds + 1)
    top, least = frequent_words(table, frequent)
    shared = spark.sparkContext.broadcast({r["word"].encode(): (math.log10(r["c"] + 1), r["lp"]) for r in top})
    end_base, end_known = math.log10(ends + 1) - below, int(ends > 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n_tokens, n_known, base, lp, lists, numbers, offsets = [], [], [], [], [], [], [0]
            for value in batch.column(1):
                found = words(value.as_py())
                sure, a, b = end_known, end_base, end_lp
                for word, n in Counter(found).items():
                    have = known.get(word)
                    if have is None:
                        lists.append(word)
                        numbers.append(n)
                    else:
                        sure += n
                        a += n * (have[0] - below)
                        b += n * have[1]
                n_tokens.append(len(found) + 1), n_known.append(sure), base.append(a), lp.append(b), offsets.append(len(lists))
            rest = pa.StructArray.from_arrays([pa.array(lists, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(lp), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)],
                ["__key", "__held", "__id", "n_tokens", "n_known", "base", "lp", "rest"],
            )

    kind = df.schema[key].dataType.simpleString()
    identified = rows.select("__key", "__text", "__held", F.xxhash64("__text").alias("__id"))
    heads = identified.mapInArrow(run, f"__key {kind}, __held boolean, __id long, n_tokens long, n_known long, base double, lp double, rest array<struct<word:string,n:long>>")
    # The sums so far travel as one more element, under a word that cannot be one: so the texts are read once.
    own = F.array(F.struct(F.concat(F.lit(" "), F.col("__id").cast("string")).alias("word"), F.lit(0).cast("long").alias("n")))
    terms = heads.select("__key", "__held", "__id", "n_tokens", "n_known", "base", "lp", F.inline(F.concat(own, "rest")))
    is_head = F.col("n") == 0
    terms = terms.select(
        "__key", "__held", "__id", "word", "n",
        *(F.when(is_head, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("n_tokens", "n_known", "base", "lp")),
    )
    rare = table.where(F.col("c") < least).select("word", F.col("c").alias("__c"), F.col("lp").alias("__lp"))
    joined = terms.join(rare, "word", "left")
    # For a rare word: known if it occurs in training, and its terms of both sums.
    summed = joined.groupBy("__key", "__held", "__id").agg(
        F.sum(F.when(is_head, 1).otherwise(0)).alias("__rows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("__c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(is_head, 0.0).otherwise(F.col("n") * (F.log10(F.col("__c") + 1.0) - below))).alias("base"),
        F.sum(F.col("lp") + F.when(is_head, 0.0).otherwise(F.col("n") * F.col("__lp"))).alias("lp"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))).alias("__row")
    share = F.col("__rows")
    return summed.select("*", each).select(
        F.col("__key").alias(key),
        F.col("__held").alias("held_out"),
        (F.col("n_tokens") / share).cast("long").alias("n_tokens"),
        (F.col("n_known") / share).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / share).alias("base_score"),
        (F.col("lp") / share).alias("score"),
    )
