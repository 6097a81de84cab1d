"""SentencePiece encoding and decoding that keeps the place of every piece in the original text.

A text is normalised first: at each place the longest entry of the model's compiled character map (a double-array trie
over bytes) is replaced, all else is copied, and for every normalised byte the original byte where its source begins is
recorded. Pieces are then merged by score, and each piece's ends are projected through that record to a span of bytes of
the original text. Pieces of a character without a piece of its own are bytes; the last of them has the whole span.

A cut is made before every run of spaces if no piece of the vocabulary has a space behind another character, so that equal
words are merged once for each Python worker and cache generation.

Defined results: a null text is encoded as an empty one, which has no ids. Repeated rows give repeated results. Other
columns, whatever their names, are left out unless they are named in ``keep``.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import column_types

#: The mark that stands for a space, and the kinds of pieces in model files.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LOST = "�"
#: Bytes of cached words after which a new generation begins, and characters of text whose new words are merged together.
#: They bound memory, not results.
CACHE_BYTES, BLOCK = 128 << 20, 1_500_000
#: The number of the first letter without a piece (all pieces have smaller ones), what stands for pairs that are never
#: merged, and the lengths of words that are merged in one matrix; longer ones are merged one by one, with a heap.
LETTER, NEVER, WIDTHS = 1 << 21, 1 << 60, (8, 12, 16, 24, 40)


class CharMap:
    """The compiled character map: a double-array trie of byte strings, each with a replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest entry that begins at ``at`` and the place of its replacement; 0 and -1 without one."""
        units, found, value = self.units, 0, -1
        node = self._jump(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found, value = k + 1 - at, units[node] & 0x7FFFFFFF
        return found, value

    def replacement(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(b"\0", value)]


class Normaliser:
    """Texts as the model wants them, with the original place of every byte."""

    def __init__(self, spec, user: list[str], suffix: bool):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix and not suffix
        self.suffix = spec.add_dummy_prefix and suffix
        self.squeeze = spec.remove_extra_whitespaces
        self.space = MARK.encode() if spec.escape_whitespaces else b" "
        self.user = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(user, key=len, reverse=True))) if user else None
        self.copies = not self.map and not self.squeeze and not self.user

    def run(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for the end the place in ``data`` where its source begins."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.copies:
            wide = np.where(np.frombuffer(data, np.uint8) == 0x20, len(self.space), 1)
            head = np.zeros(len(self.space) if self.prefix else 0, np.int64)
            tail = np.full(len(self.space) if self.suffix else 0, len(data), np.int64)
            places = np.concatenate([head, np.repeat(np.arange(len(data)), wide), tail, [len(data)]])
            return self.space * self.prefix + data.replace(b" ", self.space) + self.space * self.suffix, places
        out, places, at = bytearray(), [], 0
        spaced = self.squeeze
        begun = False
        while at < len(data):
            value, used = self._step(data, at)
            if spaced:
                value = value.lstrip(b" ")
            if value or not spaced:
                if not begun and self.prefix:
                    out += self.space
                    places += [at] * len(self.space)
                begun = True
                shown = value.replace(b" ", self.space)
                out += shown
                places += [at] * len(shown)
                if value:
                    spaced = self.squeeze and value.endswith(b" ")
            at += used
        end = at
        if not begun:
            return b"", np.zeros(1, np.int64)
        while self.squeeze and out.endswith(self.space):
            end = places[len(out) - len(self.space)]
            del out[len(out) - len(self.space) :], places[len(out) :]
        if self.suffix:
            out += self.space
            places += [end] * len(self.space)
        return bytes(out), np.array([*places, end], np.int64)

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the bytes at ``at``, and how many they are."""
        if self.user and (m := self.user.match(data, at)):
            return m[0], len(m[0])
        if self.map:
            used, value = self.map.longest(data, at)
            if used:
                return self.map.replacement(value), used
        used = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at : at + used], used


def decode_bytes(run: bytes) -> str:
    """Text of byte pieces; each byte that is no part of a character is lost by itself."""
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[: e.start].decode() + LOST + decode_bytes(run[e.start + 1 :]) if len(run) < 500 else _decode_long(run)


def _decode_long(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        try:
            out.append(run[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [run[at : at + e.start].decode(), LOST]
            at += e.start + 1
    return "".join(out)


class Pairs:
    """What two neighbouring pieces make: order of the score << 21 | number of the piece. An open hash table of arrays."""

    def __init__(self, made: dict[int, int]):
        keys, values = np.fromiter(made.keys(), np.int64, len(made)), np.fromiter(made.values(), np.int64, len(made))
        self.bits = max(10, (4 * len(made)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 22 | b).ravel()
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], NEVER)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (1 << self.bits) - 1
            there = self.keys[at[todo]]
            out[todo] = np.where(there == key[todo], self.values[at[todo]], NEVER)
            todo = todo[(there != key[todo]) & (there >= 0)]
        return out.reshape(a.shape)

    def merge(self, rows: np.ndarray) -> None:
        """In every row of letters, -1 behind the end, merge the first pair of the best score until there is none."""
        words, places = np.arange(len(rows)), np.arange(rows.shape[1])
        made = self.find(np.maximum(rows[:, :-1], 0), np.maximum(rows[:, 1:], 0))
        made[rows[:, 1:] < 0] = NEVER
        now = rows
        while True:
            at = made.argmin(1)
            best = made[np.arange(len(now)), at]
            go = best < NEVER
            if not go.all():
                rows[words] = now
                words, now, made, at, best = words[go], now[go], made[go], at[go], best[go]
            if not len(words):
                return
            one, behind = np.arange(len(now)), places > at[:, None]
            now[:, :-1] = np.where(behind[:, :-1], now[:, 1:], now[:, :-1])
            now[:, -1] = -1
            new = now[one, at] = best & (LETTER - 1)
            made[:, :-1] = np.where(behind[:, :-2], made[:, 1:], made[:, :-1])
            made[:, -1] = NEVER
            # The pair that begins with the new piece, and the one that ends with it.
            right = now[one, np.minimum(at + 1, len(places) - 1)]
            some = at < made.shape[1]
            found = np.where((right >= 0) & (at + 1 < len(places)), self.find(new, np.maximum(right, 0)), NEVER)
            made[one[some], at[some]] = found[some]
            some = at > 0
            made[one[some], at[some] - 1] = self.find(now[one[some], at[some] - 1], new[some])


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """The array, longer if need be."""
    return values if size <= len(values) else np.concatenate([values, np.zeros(max(size, len(values)), values.dtype)])


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("only byte-pair models are merged by score")
        self.names = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        words = {k for k, kind in enumerate(self.kinds) if kind in (NORMAL, USER, UNUSED)}
        self.scores = {self.names[k]: spec.pieces[k].score for k in words}
        self.ids = {self.names[k]: k for k in words} | {self.names[k]: k for k in range(len(self.names)) if k not in words}
        self.unused = {self.names[k] for k in words if self.kinds[k] == UNUSED}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = [self.ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.decimal = [str(k) for k in range(len(self.names))]
        self.byte_of = {k: int(self.names[k][3:5], 16) for k, kind in enumerate(self.kinds) if kind == BYTE}
        self.special = {k for k, kind in enumerate(self.kinds) if kind in (CONTROL, UNKNOWN)}
        self.plain = [self._plain(k) for k in range(len(self.names))]
        self.lost = spec.trainer_spec.unk_surface or " ⁇ "
        user = [self.names[k] for k in words if self.kinds[k] == USER]
        self.user = re.compile("|".join(re.escape(x) for x in sorted(user, key=len, reverse=True))) if user else None
        self.normaliser = Normaliser(spec.normalizer_spec, user, spec.trainer_spec.treat_whitespace_as_suffix)
        self.trims = spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces
        self.trims = self.trims and not spec.trainer_spec.treat_whitespace_as_suffix
        self.squeezes = spec.normalizer_spec.remove_extra_whitespaces
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cuts = not any(inner.search(x) for x in self.scores) and self.ids.get(MARK, self.unknown) != self.unknown
        self.chunks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.letters = np.arange(LETTER, LETTER + 0x110000, dtype=np.int64)
        for b in range(128 if self.byte_ids else 0):
            self.letters[b] = self.byte_ids[b] if self.byte_ids[b] != self.unknown else LETTER + b
        for x in self.scores:
            if len(x) == 1:
                self.letters[ord(x)] = self.ids[x]
        self.pairs = Pairs(self._made())
        self.lengths = np.array([1 if kind == BYTE else len(x.encode()) for x, kind in zip(self.names, self.kinds)], np.int64)
        self.clear()

    def _plain(self, k: int) -> bytes:
        """What a piece stands for within a text; bytes are put together to letters."""
        if self.kinds[k] == BYTE:
            return bytes([self.byte_of[k]])
        return b"" if self.kinds[k] in (CONTROL, UNKNOWN) else self.names[k].replace(MARK, " ").encode()

    def _made(self) -> dict[int, int]:
        """All pairs of pieces or letters that make a piece."""
        order = {x: n for n, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        out = {}
        for whole, score in self.scores.items():
            for k in range(1, len(whole)):
                a, b = (int(self.letters[ord(x)]) if len(x) == 1 else self.ids[x] if x in self.scores else -1 for x in (whole[:k], whole[k:]))
                if a >= 0 and b >= 0:
                    out[a << 22 | b] = order[score] << 21 | self.ids[whole]
        return out

    def clear(self) -> None:
        """Begin a new generation of the cache: words behind a space without it, other chunks of text, and their pieces."""
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat_ids, self.flat_lengths = np.zeros(4096, np.int32), np.zeros(4096, np.int64)
        self.used = self.size = self.entries = 0

    def _enter(self, cache: dict[str, int], keys: list[str], front: str) -> None:
        """Encode chunks of normalised text, many at once, and keep their pieces under their keys."""
        widths = np.searchsorted(WIDTHS, np.fromiter(map(len, keys), np.int64, len(keys)) + len(front))
        for k in np.unique(widths).tolist():
            group = [keys[n] for n in np.flatnonzero(widths == k)]
            chunks = [front + x for x in group]
            if k == len(WIDTHS) or self.user or self.unused:
                whole, rows = np.ones(len(group), bool), None
            else:
                lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
                rows = np.full((len(chunks), WIDTHS[k]), -1, np.int64)
                codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
                rows[np.arange(WIDTHS[k]) < lengths[:, None]] = self.letters[codes]
                self.pairs.merge(rows)
                whole = (rows >= LETTER).any(1)
                simple = rows[~whole]
                self._keep(cache, [group[n] for n in np.flatnonzero(~whole)], simple[simple >= 0], (simple >= 0).sum(1))
            for n in np.flatnonzero(whole).tolist():
                ids, lengths = self._spell(rows[n]) if rows is not None else self._merge_long(chunks[n])
                self._keep(cache, [group[n]], np.array(ids, np.int64), np.array([len(ids)]), np.array(lengths, np.int64))

    def _keep(self, cache: dict[str, int], keys: list[str], ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray | None = None) -> None:
        k, n, used = len(keys), len(ids), self.used
        self.first, self.count = _room(self.first, self.entries + k), _room(self.count, self.entries + k)
        self.flat_ids, self.flat_lengths = _room(self.flat_ids, used + n), _room(self.flat_lengths, used + n)
        self.count[self.entries : self.entries + k] = counts
        self.first[self.entries : self.entries + k] = used + counts.cumsum() - counts
        self.flat_ids[used : used + n] = ids
        self.flat_lengths[used : used + n] = self.lengths[ids] if lengths is None else lengths
        cache.update(zip(keys, range(self.entries, self.entries + k)))
        self.used, self.entries = used + n, self.entries + k
        self.size += 180 * k + 2 * sum(map(len, keys)) + 12 * n

    def _spell(self, row: np.ndarray) -> tuple[list[int], list[int]]:
        """Ids and lengths of merged pieces among which are letters without a piece."""
        ids: list[int] = []
        lengths: list[int] = []
        for k in row[row >= 0].tolist():
            self._put(self.names[k] if k < LETTER and self.kinds[k] != BYTE else chr(k - LETTER if k >= LETTER else self.byte_of[k]), ids, lengths)
        return ids, lengths

    def merge(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of normalised text, and how many of its bytes each stands for."""
        cache: dict[str, int] = {}
        self._enter(cache, [chunk], "")
        at = self.first[cache[chunk]]
        some = slice(at, at + self.count[cache[chunk]])
        return self.flat_ids[some].tolist(), self.flat_lengths[some].tolist()

    def _merge_long(self, chunk: str) -> tuple[list[int], list[int]]:
        """The same with a heap of pairs, with pieces that are never split and pieces that are kept only for merging."""
        symbols, frozen = [], []
        at = 0
        for m in self.user.finditer(chunk) if self.user else ():
            symbols += [*chunk[at : m.start()], m[0]]
            frozen += [False] * (m.start() - at) + [True]
            at = m.end()
        symbols += chunk[at:]
        frozen += [False] * (len(chunk) - at)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        scores, parts, heap, last = self.scores, {}, [], len(symbols)

        def offer(left: int, right: int) -> None:
            if left < 0 or right >= last or frozen[left] or frozen[right]:
                return
            pair = symbols[left] + symbols[right]
            score = scores.get(pair)
            if score is not None:
                heap.append((-score, left, right, pair)) if building else heapq.heappush(heap, (-score, left, right, pair))
                if pair in self.unused:
                    parts[pair] = (symbols[left], symbols[right])

        building = True
        for k in range(last - 1):
            offer(k, k + 1)
        heapq.heapify(heap)
        building = False
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            nxt = after[left] = after[right]
            if nxt < last:
                before[nxt] = left
            offer(before[left], left)
            offer(left, nxt)
        ids: list[int] = []
        lengths: list[int] = []
        for piece in filter(None, symbols):
            for x in self._split(piece, parts) if piece in self.unused else (piece,):
                self._put(x, ids, lengths)
        return ids, lengths

    def _split(self, piece: str, parts: dict[str, tuple[str, str]]) -> Iterator[str]:
        """Pieces that are kept only for merging give way to those they were merged from."""
        todo = [piece]
        while todo:
            x = todo.pop()
            if x in self.unused and x in parts:
                todo += reversed(parts[x])
            else:
                yield x

    def _put(self, piece: str, ids: list[int], lengths: list[int]) -> None:
        k, code = self.ids.get(piece, self.unknown), piece.encode()
        if k != self.unknown:
            ids.append(k)
            lengths.append(len(code))
        elif self.byte_ids:
            ids += [self.byte_ids[b] for b in code]
            lengths += [0] * (len(code) - 1) + [len(code)]
        elif ids and ids[-1] == k:
            lengths[-1] += len(code)
        else:
            ids.append(k)
            lengths.append(len(code))

    def _chunks(self, text: str) -> tuple[dict[str, int] | None, list[str], np.ndarray]:
        """The cache for a text's chunks, the chunks, and the original place of every normalised byte."""
        data = text.encode()
        normal, places = self.normaliser.run(data)
        if not normal:
            return self.parts, [], places
        if not self.cuts:
            return None, [normal.decode()], places
        if self.normaliser.copies and self.normaliser.prefix and text[0] != " " != text[-1] and "  " not in text and MARK not in text:
            return self.words, text.split(" "), places
        return self.parts, self.chunks(normal.decode()), places

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the first and end byte of each one's span."""
        block, size = [], 0
        for text in texts:
            if self.size > CACHE_BYTES and not block:
                self.clear()
            block.append(self._chunks(text or ""))
            size += len(text or "")
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for cache, front in ((self.words, MARK), (self.parts, "")):
            fresh = set(chain.from_iterable(keys for by, keys, _ in block if by is cache)).difference(cache)
            if fresh:
                self._enter(cache, list(fresh), front)
        for cache, keys, places in block:
            if cache is None:
                ids, lengths = (np.array(x, np.int64) for x in self._merge_long(keys[0]))
            else:
                at = np.fromiter(map(cache.__getitem__, keys), np.int64, len(keys))
                counts = self.count[at]
                ends = counts.cumsum()
                flat = np.repeat(self.first[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
                ids, lengths = self.flat_ids[flat], self.flat_lengths[flat]
            stops = lengths.cumsum()
            yield ids, places[stops - lengths], places[stops]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return next(self.encode_all([text]))

    def decimals(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def shown(self, ids: np.ndarray) -> bytes:
        """The decoded text. Where bytes of letters are whole, as in encoded texts, it is that of the pieces one by one."""
        out = b"".join(map(self.plain.__getitem__, ids.tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            return self.decode(ids.tolist()).encode()
        if self.special and not self.special.isdisjoint(ids.tolist()):
            return self.decode(ids.tolist()).encode()
        return out[self._trim(ids, out) :]

    def _trim(self, ids: np.ndarray, shown: bytes) -> int:
        """Spaces that decoding takes from the front: one, or all where normalising squeezes them."""
        if not self.trims or not len(ids) or not self.names[ids[0]].startswith(MARK):
            return 0
        return len(shown) - len(shown.lstrip(b" ")) if self.squeezes else 1

    def _text(self, ids, trim: bool) -> str:
        """Text of ids; with ``trim`` without the space that encoding puts in front."""
        out: list[str] = []
        run = bytearray()
        front = trim and self.trims
        for k in ids:
            byte = self.byte_of.get(k)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(decode_bytes(bytes(run)))
                run.clear()
            front = front and not any(out)
            kind = self.kinds[k]
            if kind == CONTROL:
                continue
            shown = self.lost if kind == UNKNOWN else self.plain[k].decode()
            if front and kind != UNKNOWN and shown.startswith(" "):
                shown, front = shown[1:], self.squeezes
            out.append(shown)
        out.append(decode_bytes(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._text(ids, True)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_CODECS: dict[str, Codec] = {}


@contextmanager
def _codec(digest: str, model) -> Iterator[Codec]:
    """One for each Python worker and model; its cache lives as long as the task.

    Entries of the cache hold no cycles, so looking for some among millions of them is left out meanwhile.
    """
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(model.value)
    gc.disable()
    try:
        yield _CODECS[digest]
    finally:
        _CODECS[digest].clear()
        gc.enable()


def _shared(df: DataFrame, model: str | None):
    """The model file, below a MB whatever the input, for all workers, and its digest."""
    with open(model or default_model(), "rb") as f:
        content = f.read()
    return hashlib.sha256(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = True, model: str | None = None) -> DataFrame:
    """Encode each text and decode it again. One narrow stage, no shuffle.

    Returns the ``keep`` columns, n_tokens, span_bytes (bytes of the original text that lie in the span of a piece), with
    ``ids`` the ids and the first and end byte of each one's span, and with ``digests`` the SHA-256 of the ids as decimal
    text joined by commas and of the decoded text.
    """
    digest, content = _shared(df, model)
    out = ["n_tokens long", "span_bytes long"] + ["ids array<int>", "starts array<long>", "ends array<long>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*column_types(source.schema.fields[:-1]), *out])

    def told(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, covered, spans, a, b = [], [], [], [], []
        for tokens, starts, ends in codec.encode_all(x.as_py() for x in batch.column(batch.num_columns - 1)):
            lengths.append(len(tokens))
            covered.append(int((ends - starts).sum()))
            if ids:
                spans.append((tokens, starts, ends))
            if digests:
                a.append(hashlib.sha256(codec.decimals(tokens).encode()).hexdigest())
                b.append(hashlib.sha256(codec.shown(tokens)).hexdigest())
        columns = [*batch.columns[:-1], pa.array(lengths, pa.int64()), pa.array(covered, pa.int64())]
        if ids:
            offsets = pa.array([0, *accumulate(lengths)], pa.int32())
            for k, kind in enumerate((np.int32, np.int64, np.int64)):
                values = np.concatenate([x[k] for x in spans]) if spans else np.zeros(0, kind)
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind))))
        if digests:
            columns += [pa.array(a, pa.string()), pa.array(b, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *(x.split(" ")[0] for x in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(digest, content) as codec:
            for batch in batches:
                yield told(codec, batch)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """The text of each list of ids; null for null."""
    digest, content = _shared(df, model)
    source = df.select(*keep, F.col(ids).alias("__ids"))
    schema = ", ".join([*column_types(source.schema.fields[:-1]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(digest, content) as codec:
            for batch in batches:
                texts = [None if x is None else codec.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return source.mapInArrow(run, schema)
