"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's leaves are the pairs of one pre-token; a node holds the smallest of its leaves, a leaf being the rank and then
the place of its pair. The root is therefore the leftmost pair of the lowest rank. A merge changes three leaves, each in
logarithmic time, and the word is done when the root holds nothing.

Defined results: a null text is encoded as an empty one; an empty text has no ids. Repeated rows give repeated results.
Other columns, whatever their names, are left out unless they are named in ``keep``.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 62
PLACE = 1 << 32
#: Entries of one generation of the word caches, and the longest word that is kept. They bound memory, not results.
CACHE, LONGEST = 50_000, 64
#: Characters of text whose words are taken together, new words cut and merged in one turn, words in one matrix, and the
#: mark of a text's first word.
BLOCK, TURN, WIDTH, FIRST = 1_500_000, 30_000, 8192, "\n"
#: The pre-tokenizer of byte-level vocabularies, and the white space that joins neighbouring words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOSE = r"^ | $| \s|\s "
#: The same inside ASCII text: a space next to white space.
LOOSE_PAIRS = sorted({pair for c in " \t\n\v\f\r" for pair in (" " + c, c + " ")})


def merge(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge the ids of one word. ``ranks``: left id * 2**20 + right id to rank; ``merged``: rank to id."""
    ids, pairs = list(ids), len(ids) - 1
    if pairs < 1:
        return ids
    size = 1 << (pairs - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(pairs):
        rank = ranks.get(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * PLACE + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(leaf: int, value: int) -> None:
        k = size + leaf
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    after, before = list(range(1, pairs + 2)), list(range(-1, pairs))
    while (root := tree[1]) < NONE:
        rank, i = divmod(root, PLACE)
        gone = after[i]
        right = after[i] = after[gone]
        ids[i], ids[gone] = merged[rank], -1
        if gone < pairs:
            put(gone, NONE)
        if right <= pairs:
            before[right] = i
            rank = ranks.get(ids[i] << 20 | ids[right])
            put(i, NONE if rank is None else rank * PLACE + i)
        else:
            put(i, NONE)
        left = before[i]
        if left >= 0:
            rank = ranks.get(ids[left] << 20 | ids[i])
            put(left, NONE if rank is None else rank * PLACE + left)
    return [x for x in ids if x >= 0]


def packed(ids: np.ndarray | list[int]) -> bytes:
    """Ids as they are kept by word, four bytes each: a tuple takes eight, and its numbers 28 more."""
    return np.asarray(ids, np.int32).tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()


class Forest:
    """The same trees for many words at once: one column of numpy arrays for each word."""

    def __init__(self, ranks: dict[int, int], merged: list[int]):
        keys = np.fromiter(ranks.keys(), np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(ranks.values(), np.int64, len(ranks))[order]
        self.merged = np.array(merged, np.int64)

    def leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at] << 6 | place, NONE)

    def merge(self, rows: np.ndarray) -> list[bytes]:
        """``rows``: ids of words of up to ``size`` + 1 symbols, -1 behind the end, two columns more than symbols."""
        ids = np.ascontiguousarray(rows.T)
        size, width = len(ids) - 2, ids.shape[1]
        tree = np.full((2 * size, width), NONE, np.int64)
        for i in range(size):
            tree[size + i] = self.leaf(ids[i], ids[i + 1], np.int64(i))
        for k in range(size - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        after = np.repeat(np.arange(1, size + 3)[:, None], width, 1)
        before = np.repeat(np.arange(-1, size + 1)[:, None], width, 1)

        def put(leaf: np.ndarray, word: np.ndarray, value: np.ndarray | int) -> None:
            k = size + leaf
            tree[k, word] = value
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                tree[k, word] = np.minimum(tree[2 * k, word], tree[2 * k + 1, word])

        word = np.flatnonzero(tree[1] < NONE)
        while len(word):
            root = tree[1, word]
            i = root & 63
            gone = after[i, word]
            right = np.minimum(after[gone, word], size + 1)
            ids[i, word], ids[gone, word], after[i, word], before[right, word] = self.merged[root >> 6], -1, right, i
            put(np.where(gone < size, gone, i), word, NONE)
            put(i, word, self.leaf(ids[i, word], ids[right, word], i))
            left = before[i, word]
            some = left >= 0
            if some.any():
                left, at = left[some], word[some]
                put(left, at, self.leaf(ids[left, at], ids[i[some], at], left))
            word = word[tree[1, word] < NONE]
        sizes, flat = 4 * (ids >= 0).sum(0), packed(ids.T[(ids >= 0).T])
        ends = sizes.cumsum().tolist()
        return [flat[e - n : e] for e, n in zip(ends, sizes.tolist())]


class Kept:
    """Values by word, in two generations, so that memory stays bounded and frequent words stay."""

    def __init__(self, make):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.now, self.old, self.long = {}, {}, []

    def fill(self, wanted: set[str]) -> dict[str, bytes]:
        """After this, ``now`` has all that is wanted."""
        missing = wanted.difference(self.now)
        again = {word: self.old[word] for word in missing if word in self.old}
        self.now.update(again)
        unknown = list(missing.difference(again))
        for some in (unknown[k : k + TURN] for k in range(0, len(unknown), TURN)):
            self.now.update(zip(some, self.make(some)))
            self.long += [word for word in some if len(word) > LONGEST]
        return self.now

    def age(self) -> None:
        """Only words that came since the last time are looked at, not the whole cache."""
        for word in self.long:
            del self.now[word]
        self.long = []
        if len(self.now) >= CACHE:
            self.old, self.now = self.now, {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """One vocabulary file's encoder and decoder."""

    def __init__(self, vocabulary: str):
        import regex

        spec = json.loads(vocabulary)
        ids, letters = spec["model"]["vocab"], byte_letters()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.merged = [ids[a + b] for a, b in pairs]
        self.start = [0] * 256
        for letter, byte in letters.items():
            self.start[byte] = ids[letter]
        self.pieces = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, k in ids.items():
            self.pieces[k] = bytes(letters[c] for c in token)
        for token, k in added.items():
            self.pieces[k] = token.encode()
        self.numbers = [str(k) for k in range(len(self.pieces))]
        self.added = added
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pre_tokens = regex.compile(PATTERN).findall
        self.loose = regex.compile(LOOSE).search
        self.forest = Forest(self.ranks, self.merged)
        self.words, self.chunks = Kept(self.packed_words), Kept(self.packed_chunks)

    def make_words(self, words: list[str]) -> list[list[int]]:
        return [*map(unpacked, self.packed_words(words))]

    def packed_words(self, words: list[str]) -> list[bytes]:
        out = [b""] * len(words)
        start, classes = np.array(self.start, np.int64), {}
        for n, word in enumerate(words):
            code = word.encode()
            classes.setdefault(1 << max(0, len(code) - 2).bit_length(), []).append((n, code))
        for size, group in classes.items():
            if size > 32:
                for n, code in group:
                    out[n] = packed(merge([self.start[b] for b in code], self.ranks, self.merged))
                continue
            for some in (group[k : k + WIDTH] for k in range(0, len(group), WIDTH)):
                lengths = np.array([len(code) for _, code in some])
                rows = np.full((len(some), size + 2), -1, np.int64)
                rows[np.arange(size + 2) < lengths[:, None]] = start[np.frombuffer(b"".join(code for _, code in some), np.uint8)]
                for (n, _), ids in zip(some, self.forest.merge(rows)):
                    out[n] = ids
        return out

    def packed_chunks(self, chunks: list[str]) -> list[bytes]:
        """ASCII letters alone, or digits alone, are one pre-token, which need not be kept as a word too; others are cut by
        the pattern."""
        found = [(" " + x,) if x.isascii() and (x.isalpha() or x.isdigit()) else self.pre_tokens(x[1:] if x[0] == FIRST else " " + x) for x in chunks]
        alone = iter(self.packed_words([x[0] for x in found if len(x) == 1]))
        ids = self.words.fill(set(chain.from_iterable(x for x in found if len(x) > 1)))
        return [next(alone) if len(x) == 1 else b"".join(map(ids.__getitem__, x)) for x in found]

    def parts(self, text: str) -> list[str] | None:
        """No pre-token crosses a single space between two words, so these split the text; None where they don't."""
        if text[0] == " " or text[-1] == " " or any(x in text for x in LOOSE_PAIRS) if text.isascii() else self.loose(text):
            return None
        parts = text.split(" ")
        parts[0] = FIRST + parts[0]
        return parts

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        return map(unpacked, self.packed_all(texts))

    def packed_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Texts are taken some MB at a time: new words of all of them are merged together."""
        block, size = [], 0
        for text in texts:
            pieces: list = []
            if text:
                spans = self.special.split(text) if any(x in text for x in self.added) else [text]
                for n, span in enumerate(spans):
                    if n % 2:
                        pieces.append(([packed([self.added[span]])], None))
                    elif span:
                        parts = self.parts(span)
                        pieces.append((self.pre_tokens(span), self.words) if parts is None else (parts, self.chunks))
            block.append(pieces)
            size += len(text or "")
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list) -> Iterator[bytes]:
        for kept in (self.words, self.chunks):
            kept.fill(set(chain.from_iterable(parts for pieces in block for parts, by in pieces if by is kept)))
        for pieces in block:
            yield b"".join(chain.from_iterable(parts if by is None else map(by.now.__getitem__, parts) for parts, by in pieces))
        self.words.age()
        self.chunks.age()

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_CODECS: dict[str, Codec] = {}


@contextmanager
def _codec(digest: str, vocabulary) -> Iterator[Codec]:
    """One for each Python worker and vocabulary; its caches live as long as the task.

    Entries of the caches hold no cycles, so looking for some among them is left out meanwhile.
    """
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(vocabulary.value)
    codec = _CODECS[digest]
    gc.disable()
    try:
        yield codec
    finally:
        gc.enable()
        for kept in (codec.words, codec.chunks):
            kept.clear()
        pa.default_memory_pool().release_unused()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about a block of text each, one at least: what is made of them is handed on before the next are taken."""
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _shared(df: DataFrame, vocabulary: str | None):
    """The vocabulary file, a few MB whatever the input, for all workers, and its digest."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        content = f.read()
    return hashlib.sha256(content.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = True, vocabulary: str | None = None) -> DataFrame:
    """Encode each text and decode it again.

    Returns the ``keep`` columns, n_tokens, with ``ids`` the ids, and with ``digests`` the SHA-256 of the ids as decimal
    text joined by commas and of the decoded text. One narrow stage, no shuffle.
    """
    digest, content = _shared(df, vocabulary)
    out = ["n_tokens long"] + ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(digest, content) as codec:
            yield from told(codec, batches)

    def told(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_slices, batches)):
            lengths, all_ids, a, b = [], [], [], []
            texts = (value.as_py() for value in batch.column(batch.num_columns - 1))
            for code in codec.packed_all(texts):
                lengths.append(len(code) // 4)
                if ids:
                    all_ids.append(code)
                if digests:
                    tokens = unpacked(code)
                    a.append(hashlib.sha256(",".join(map(codec.numbers.__getitem__, tokens)).encode()).hexdigest())
                    b.append(hashlib.sha256(codec.decode(tokens).encode()).hexdigest())
            columns = [*batch.columns[:-1], pa.array(lengths, pa.int64())]
            names = [*batch.schema.names[:-1], "n_tokens"]
            if ids:
                offsets = pa.array([0, *accumulate(lengths)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(all_ids), np.int32))))
                names.append("ids")
            if digests:
                columns += [pa.array(a, pa.string()), pa.array(b, pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """The text of each list of ids; null for null."""
    digest, content = _shared(df, vocabulary)
    source = df.select(*keep, F.col(ids).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(digest, content) as codec:
            for batch in batches:
                texts = [None if x is None else codec.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return source.mapInArrow(run, schema)
