"""Exact Jaccard self-join on word n-grams by universe partition and pigeonhole.

Documents are sets of hashed word 5-grams; equal sets are one node. Two sets of sizes r <= s with a Jaccard similarity of
at least t differ in at most H = (r + s) * (1 - t) / (1 + t) elements. Sizes fall into bands; each band cuts the universe
of hashes into m segments, so of two similar sets some segment must agree closely: if segment i is given a threshold of
t_i and these sum to H + 1, then some segment differs in fewer than t_i elements. Threshold 1 needs an equal subset;
threshold 2 also one deletion, so small bands index every one-deletion neighbour of every subset too. Thresholds are
allocated where they cost least: an equal subset of many elements is rarer than one of few, an empty one matches half the
world, and a deletion costs an entry for each element. A set is indexed in its own band and probes the bands of all
smaller sets that it may be similar to.

Larger bands have more segments than the pigeonhole asks for. There similar sets must agree in several segments, m less
the greatest difference less the empty ones, and a set that meets others in fewer is out: a passage that many documents
quote fills whole segments of them, but few.

Signatures of all sets meet in a shuffle by signature, a part of them at a time; each signature found in two nodes makes pairs with one centre
only, these are verified on the sets themselves, and links are joined into components. Signatures that still span several
components are tried again with other centres; links inside a component need no proof. What is left open, sets that agree
in some segment but are in different components, is paired by the rarest elements, which similar sets must share too.
So copies and near copies, however many, never make all pairs, and no link between different components is missed.

Defined results: null text, or text without words, has an empty set and is its own component (of its key, null included).
Equal texts, repeated rows included, share a component. A component is named by the smallest key in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytally.llm.common import discard, stage, stage_at

#: Up to this size bands index deletions; how much larger than the least number of segments larger bands are cut.
SMALL, SLACK = 64, 1.25
ROUNDS = 2
#: Signatures meet in so many turns, by their highest bits (a power of two): the disk holds the shuffle of one of them.
TURN_BITS = 3
TURNS = 2**TURN_BITS
PARTS = [f"parts_{turn}" for turn in range(TURNS)]
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = x + K1
    x = (x ^ (x >> np.uint64(30))) * K2
    x = (x ^ (x >> np.uint64(27))) * K3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, of the words seen last; the bound is on memory only."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, found: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingles(text: str | None, n: int, hashes: Words) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; of all its words if it has fewer; empty without words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = hashes(found)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * K2 + h[k : k + len(out)]
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Scheme:
    """Bands and thresholds for a similarity of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, r: int, s: int) -> int:
        return (r + s) * (100 - self.percent) // (100 + self.percent)

    def least(self, s: int) -> int:
        return -(-s * self.percent // 100)

    def most(self, r: int) -> int:
        return r * 100 // self.percent

    def band(self, size: int) -> tuple[int, int]:
        """Smallest and largest size of the band of a size."""
        lo = 1
        while (hi := max(lo, lo * 5 // 4)) < size:
            lo = hi + 1
        return lo, hi

    def bands(self, s: int) -> list[tuple[int, int]]:
        """Those of all sizes up to ``s`` that a set of ``s`` elements can be similar to."""
        out = [self.band(s)]
        while out[-1][0] > self.least(s):
            out.append(self.band(out[-1][0] - 1))
        return out

    def segments(self, hi: int) -> int:
        need = self.differ(hi, self.most(hi)) + 1
        return max(1, (3 * need + 3) // 4 if hi <= SMALL else int(need * SLACK) + 1)


def subsets(tokens: np.ndarray, lo: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each of m segments of the universe: number of elements and sum of their hashes; each element's segment and hash."""
    h = mix(tokens ^ np.uint64(lo))
    at = ((h >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, h = at[order], mix(h[order])
    size = np.bincount(at, minlength=m)
    total = np.zeros(m, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    total[at[starts]] = np.add.reduceat(h, starts)
    return size, total, at, h


def allocate(size: np.ndarray, need: int) -> np.ndarray:
    """Thresholds of the segments of a small band that sum to ``need`` at the least cost.

    The first step of a segment costs one entry and matches the more sets the fewer elements it has; the second costs an
    entry for each element. Empty segments come last.
    """
    first = 1.0 + 8.0 * 0.25 ** np.minimum(size, 30)
    first[size == 0] = 1e6
    out = np.zeros(len(size), np.int64)
    second = size + 8.0 * 0.25 ** np.maximum(np.minimum(size, 30) - 1, 0)
    second[size == 0] = 1e9
    second = np.maximum(second, first)
    cost = np.concatenate([first, second])
    # A second step is never cheaper than the first of its segment, so the cheapest steps are an allocation.
    for step in np.argsort(cost, kind="stable")[:need]:
        out[step % len(size)] += 1
    return out


NORMAL, INDEX, PROBE = 0, 1, 2


def signatures(tokens: np.ndarray, scheme: Scheme) -> list[tuple[np.ndarray, int, int, int]]:
    """Signatures of a set in parts (signatures, kind, way, least).

    Signatures of empty subsets only join an index entry with a probe. ``way`` counts the bands down from the set's own,
    0; a set similar to this one shares at least ``least`` of the signatures of kind NORMAL of one way.
    """
    out: list[tuple[np.ndarray, int, int, int]] = []
    s = len(tokens)
    for way, (lo, hi) in enumerate(scheme.bands(s)):
        m = scheme.segments(hi)
        size, total, at, h = subsets(tokens, lo, m)
        seat = mix(np.arange(m, dtype=np.uint64) ^ (np.uint64(lo) << np.uint64(32)))
        key = mix(seat ^ total)
        if hi <= SMALL:
            t = allocate(size, scheme.differ(min(hi, s), s) + 1)
            wanted = (t > 0) | (way == 0)
            deleted = (t[at] > 1) | (way == 0)
            less, left = mix(seat[at] ^ (total[at] - h)), size[at] - 1
            out.append((np.concatenate([key[wanted & (size > 0)], less[deleted & (left > 0)]]), NORMAL, way, 1))
            if way == 0:
                out.append((np.concatenate([key[size == 0], less[left == 0]]), INDEX, way, 1))
            out.append((np.concatenate([key[(size == 0) & (t > 0)], less[(left == 0) & (t[at] > 1)]]), PROBE, way, 1))
            continue
        # Its own band holds sets up to the largest that this one can be similar to; lower bands sets up to hi.
        differ = scheme.differ(s, scheme.most(s)) if way == 0 else scheme.differ(min(hi, s), s)
        least = m - differ - int((size == 0).sum())
        out.append((key[size > 0], NORMAL, way, max(1, least)))
        if way == 0:
            out.append((key[size == 0], INDEX, way, 1))
        if least < 1:
            out.append((key[size == 0], PROBE, way, 1))
    return [x for x in out if len(x[0])]


def set_id(tokens: np.ndarray) -> int:
    """Name of a set: the same for equal sets."""
    return int(np.add.reduce(mix(tokens ^ K3)).astype(np.int64)) if len(tokens) else 0


def _map_sets(df: DataFrame, n: int, schema: str, make) -> DataFrame:
    """``df`` (any columns, the last one the text) to rows of ``schema`` that ``make(columns, sets)`` gives by batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            sets = (shingles(x.as_py(), n, hashes) for x in batch.column(batch.num_columns - 1))
            yield from make(batch.columns[:-1], sets)

    return df.mapInArrow(run, schema)


def _row(key: str, text: str) -> Column:
    """A number for a row, which spreads copies of a text by their keys."""
    return F.xxhash64(F.col(key).cast("string"), text)


def describe(df: DataFrame, key: str, text: str, n: int, scheme: Scheme) -> DataFrame:
    """Per row: key, row (its number), sid (0 for the empty set), n_shingles, and for each turn parts (tag, signs) of its
    signatures.

    Equal sets of one task are signed once; ``tag`` packs the kind, way and least of ``signatures``.
    """
    seen: set[int] = set()

    def make(columns, sets):
        at, rows, size = 0, [], 0

        def full():
            parts = [part for row in rows for part in row[2]]
            ends = pa.array(np.cumsum([0, *(len(row[2]) for row in rows)]), pa.int32())
            signs = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in parts)])
            of_part = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            turns = signs >> np.uint64(64 - TURN_BITS)
            tags = pa.array([kind + 3 * (way + 16 * least) for _, kind, way, least in parts], pa.int32())
            told = []
            for turn in range(TURNS):
                now = turns == turn
                bounds = np.concatenate([[0], np.cumsum(np.bincount(of_part[now], minlength=len(parts)))])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signs[now].view(np.int64)))
                told.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([tags, lists], ["tag", "signs"])))
            made = [*(c.slice(at, len(rows)) for c in columns), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), *told]
            return pa.RecordBatch.from_arrays(made, ["key", "row", "sid", "n_shingles", *PARTS])

        for x in sets:
            sid = set_id(x)
            new = len(x) > 0 and sid not in seen
            seen.add(sid)
            rows.append((sid, len(x), signatures(x, scheme) if new else []))
            size += sum(len(part[0]) for part in rows[-1][2])
            if size > 500_000:
                yield full()
                at, rows, size = at + len(rows), [], 0
        if rows:
            yield full()

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, row long, sid long, n_shingles long, " + ", ".join(f"{p} array<struct<tag: int, signs: array<long>>>" for p in PARTS)
    return _map_sets(df.select(F.col(key).alias("key"), _row(key, text), F.col(text)), n, schema, make)


def sets_of(df: DataFrame, key: str, text: str, n: int, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (sid, tokens) of the sets in ``wanted`` (sid), once each, from one row of ``df`` for each of them."""

    def make(_, sets):
        found = [(set_id(x), x.view(np.int64)) for x in sets if len(x)]
        if found:
            offsets = np.cumsum([0, *(len(x) for _, x in found)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([x for _, x in found])))], ["sid", "tokens"]
            )

    rows = stage(names.where("sid != 0").groupBy("sid").agg(F.min("row").alias("__row")).join(wanted, "sid", "left_semi").select("__row"), "rows")
    chosen = df.select(_row(key, text).alias("__row"), F.col(text).alias("__text")).join(rows, "__row", "left_semi").select("__text")
    return _map_sets(chosen, n, "sid long, tokens array<long>", make).groupBy("sid").agg(F.first("tokens").alias("tokens"))


#: Of a tag.
KIND, WAY, LEAST = "tag % 3", "tag div 3 % 16", "tag div 48"


def agreeing(told: DataFrame) -> DataFrame:
    """Rows (sid, sign, tag) of the signatures in ``told`` that may join similar sets: signatures of two sets or more, one
    of them in its own band (of empty subsets, with a probe too), of sets that have enough of them in one band. What is
    out can take others with it, so the test is made twice.

    Most signatures are of one set alone and end in the first test, which is made in turns: each reads its own column and
    gives back its shuffle before the next. The window's frame is the whole group, which Spark spills; rows are 20 bytes.
    """
    group = W.partitionBy("sign")

    def met(rows: DataFrame) -> DataFrame:
        seen = rows.select("*", F.min("sid").over(group).alias("__lo"), F.max("sid").over(group).alias("__hi"), F.min(F.expr(WAY)).over(group).alias("__way"), F.max(F.expr(KIND)).over(group).alias("__kind"))
        return seen.where(f"__lo != __hi and __way = 0 and __kind != {INDEX}").select("sid", "sign", "tag")

    def enough(rows: DataFrame) -> DataFrame:
        few = rows.where(f"{KIND} = {NORMAL}").groupBy("sid", "tag").agg(F.count(F.lit(1)).alias("__n")).where(f"__n < {LEAST}")
        return rows.join(few.select("sid", "tag"), ["sid", "tag"], "left_anti")

    def signed(parts: str) -> DataFrame:
        return told.select("sid", F.explode(parts).alias("__part")).select("sid", F.explode("__part.signs").alias("sign"), F.col("__part.tag").alias("tag"))

    spark = told.sparkSession
    first = [stage_at(met(signed(parts)).distinct(), "live") for parts in PARTS]
    paths = [path for _, path in first]
    once = spark.read.schema(first[0][0].schema).parquet(*paths)
    again, second = stage_at(met(enough(once)), "live")
    live = stage(enough(again), "live")
    for path in (*paths, second):
        discard(spark, path)
    return live


def prefixes(nodes: DataFrame, sets: DataFrame, percent: int, within: bool = False) -> DataFrame:
    """Rows (sid, comp, token, n, __at, central): the elements of each of ``nodes`` (sid, comp) that a similar set must share
    one of, if others hold them.

    In one order of all elements similar sets share one of their first n - ceil(n * percent / 100) + 1 elements. Between
    components the order is by the number of components that hold an element: the elements that only copies in one
    component share, however many, come first and make no pairs, a passage that many components quote comes last.
    ``within`` components it is from the rarest element. ``central`` is the mean number of sets that hold an element of the
    set: of many near copies of a text, that text or the least changed ones have the most.
    """
    token = nodes.join(sets, "sid").select("sid", "comp", F.size("tokens").alias("n"), F.explode_outer("tokens").alias("token"))
    held = F.count(F.lit(1))
    counts = token.groupBy("token").agg(held.alias("held"), (held if within else F.countDistinct("comp")).alias("df"))
    placed = token.join(counts, "token")
    of_set = W.partitionBy("sid")
    placed = placed.select("*", F.row_number().over(of_set.orderBy("df", "token")).alias("__at"), F.avg("held").over(of_set).alias("central"))
    first = placed.where((F.col("__at") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1) & (F.col("df") > 1))
    return first.select("sid", "comp", "token", "n", "__at", "central")


def central_pairs(first: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set of ``prefixes`` with the most central set of each of its elements, if in another component."""
    centre = first.groupBy("token").agg(F.max_by(F.struct("sid", "comp"), F.struct("central", "sid")).alias("__centre"))
    return first.join(centre, "token").where("comp != __centre.comp").select(F.col("sid").alias("a"), F.col("__centre.sid").alias("b"))


def rare_pairs(first: DataFrame, percent: int, within: bool = False) -> DataFrame:
    """Pairs (a, b) of ``prefixes`` in different components that can reach the similarity; ``within``: in one component,
    each pair once.

    Of a pair's common elements the first has all others behind it in both sets, so only elements with enough behind them
    count.
    """
    other = first.select("token", F.col("sid").alias("b"), F.col("comp").alias("__comp"), F.col("n").alias("__m"), F.col("__at").alias("__bt"))
    fits = F.least("n", "__m") * 100 >= F.greatest("n", "__m") * percent
    behind = (1 + F.least(F.col("n") - F.col("__at"), F.col("__m") - F.col("__bt"))) * (100 + percent) >= (F.col("n") + F.col("__m")) * percent
    if within:
        met = first.join(other, (first["token"] == other["token"]) & (F.col("comp") == F.col("__comp"))).where(F.expr("sid < b") & fits & behind)
        return met.select(F.col("sid").alias("a"), "b").distinct()
    return first.join(other, "token").where(F.expr("comp < __comp") & fits & behind).select(F.col("sid").alias("a"), "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("__a"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("__b"))
    both = F.size(F.array_intersect("__a", "__b"))
    union = F.size("__a") + F.size("__b") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * percent).select("a", "b")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (sid, comp) for every end of a link; comp is the smallest sid reached. ``known``: those of a part of the links."""
    ends = stage(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(links.select("b", "a")), "links")
    first = ends.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("sid"), F.least("x", "y").alias("comp"))
    if known is not None:
        first = first.unionAll(known).groupBy("sid").agg(F.min("comp").alias("comp"))
    label = stage(first, "label")
    while True:
        near = ends.join(label.select(F.col("sid").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        hop = label.join(near, label["sid"] == near["x"]).select("sid", "comp", F.least("comp", "near").alias("__to"))
        over = label.select(F.col("sid").alias("__to"), F.col("comp").alias("__over"))
        new = stage(hop.join(over, "__to").select("sid", F.least("__to", "__over").alias("comp"), (F.col("comp") != F.least("__to", "__over")).alias("moved")), "label")
        if not new.where("moved").limit(1).count():
            return new.select("sid", "comp")
        label = new.select("sid", "comp")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links), n_links (other rows at the similarity).

    Components need a few links of each set. The number of all, which grows with the square of a group's size, is
    counted only if n_links is used.
    """
    scheme = Scheme(percent)
    told, path = stage_at(describe(df, key, text, n, scheme), "told")
    names = stage(told.drop(*PARTS), "names")
    live = agreeing(told).select("sid", "sign", F.expr(KIND).alias("kind")).distinct()
    # The signatures are most of the disk that is used; nothing reads them any more.
    discard(df.sparkSession, path)
    normal, empty = live.where(F.col("kind") == NORMAL), live.where(F.col("kind") != NORMAL)
    wanted = live.select("sid").distinct()
    sets = stage(sets_of(df, key, text, n, names, wanted), "sets")
    size = sets.select("sid", F.size("tokens").alias("n"))

    def fitting(pairs: DataFrame, tried: DataFrame | None = None) -> DataFrame:
        """Distinct pairs a < b that are not ``tried`` and whose sizes allow the similarity.

        One aggregation finds the distinct ones and those tried: a pair comes once for each common signature, and an anti-join
        would be made, by Spark's order of the steps, on all of these.
        """
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("__tried"))
        if tried is not None:
            pairs = pairs.unionAll(tried.select("a", "b", F.lit(True)))
        pairs = pairs.groupBy("a", "b").agg(F.max("__tried").alias("__tried")).where("NOT __tried").select("a", "b")
        pairs = pairs.join(size.select(F.col("sid").alias("a"), F.col("n").alias("__n")), "a").join(size.select(F.col("sid").alias("b"), F.col("n").alias("__m")), "b")
        return pairs.where(F.least("__n", "__m") * 100 >= F.greatest("__n", "__m") * percent).select("a", "b")

    probes = empty.where(F.col("kind") == PROBE).select("sign", F.col("sid").alias("a"))
    index = empty.where(F.col("kind") == INDEX).select("sign", F.col("sid").alias("b"))
    tried = stage(fitting(probes.join(index, "sign").select("a", "b")), "tried")
    links, comps = verified(tried, sets, percent), None
    open_signs = normal.withColumn("comp", F.col("sid"))
    rare = None
    for turn in range(ROUNDS + 2):
        if turn < ROUNDS:
            # One centre for each signature. First the same for as many as possible, then by chance.
            order = F.xxhash64(F.lit(turn), "sid", F.pmod("sign", F.lit(1 if turn == 0 else 4)))
            centre = open_signs.groupBy("sign").agg(F.min_by("sid", order).alias("b"), F.min_by("comp", order).alias("__comp"))
            found = open_signs.join(centre, "sign").where("comp != __comp").select(F.col("sid").alias("a"), "b")
        elif turn == ROUNDS:
            rare = stage(prefixes(open_signs.select("sid", "comp").distinct(), sets, percent), "prefix")
            found = central_pairs(rare)
        else:
            # The order of the elements stays, the components are those of now.
            now = rare.drop("comp").join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
            found = rare_pairs(now, percent)
        new = stage(fitting(found, tried), "pairs")
        tried = tried.unionAll(new)
        links = stage(links.unionAll(verified(new, sets, percent)), "links")
        comps = components(links, comps)
        if turn < ROUNDS:
            named = normal.join(comps, "sid", "left").select("sid", "sign", F.coalesce("comp", "sid").alias("comp"))
            spans = named.groupBy("sign").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).where("__lo != __hi")
            open_signs = stage(named.join(spans.select("sign"), "sign", "left_semi"), "open")
            if not open_signs.limit(1).count():
                break
    # Every link is inside a component.
    copies = names.where("sid != 0").groupBy("sid").agg(F.count(F.lit(1)).alias("__copies"))
    every = verified(rare_pairs(prefixes(comps, sets, percent, within=True), percent, within=True), sets, percent)
    ends = every.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("sid")), F.struct(F.col("b").alias("x"), F.col("a").alias("sid"))))).select("col.*")
    degree = ends.join(copies, "sid").groupBy(F.col("x").alias("sid")).agg(F.sum("__copies").alias("__others"))
    # From rows to sets to components, so that a hot set or component is summed before it is joined.
    by_set = names.where("sid != 0").groupBy("sid").agg(F.min("key").alias("__key"), F.count(F.lit(1)).alias("__copies"))
    by_set = by_set.join(comps, "sid", "left").select("sid", "__key", "__copies", F.coalesce("comp", "sid").alias("comp"))
    smallest = by_set.groupBy("comp").agg(F.min("__key").alias("component_id"))
    named = by_set.join(smallest, "comp").join(degree, "sid", "left").select("sid", "component_id", (F.col("__copies") - 1 + F.coalesce("__others", F.lit(0))).alias("n_links"))
    # Empty sets are many rows of one sid: they are not joined.
    full = names.where("sid != 0").join(named, "sid").select(F.col("key").alias(key), "n_shingles", "component_id", "n_links")
    none = names.where("sid = 0").select(F.col("key").alias(key), "n_shingles", F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionAll(none)
