"""Target draw, centroids and sentence pieces against brute force and the library, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skytally.llm import centroids, pieces, target

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
SCHEMA = "doc_id long, text string, rank string, score string, n_words string, __row string, __segment string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    w = re.findall(WORD, low(text))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_draw(rows, items, percent=5):
    def count(texts):
        c = Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])
        return c, float(sum(c.values()) + 10_000)

    (s, all_s), (t, all_t) = count([t for _, t in rows]), count(items)
    out = []
    for k, text in rows:
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1.0) * all_s) / ((s[b] + 1.0) * all_t))) for b in (zlib.crc32(x.encode()) % 10_000 for x in f))
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(f), weight, score, None, len(w)])
    fit = sorted((x for x in out if x[3] is not None and x[5] >= 20), key=lambda x: (-x[3], x[0], x[1]))
    for n, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = n + 1
    return [tuple(x[:5]) for x in out]


def same(df, expected):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(expected, key=key)


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    vocabulary = [random.choice("ABCabcdé中1") + "".join(random.choice("abcdefgh") for _ in range(random.randint(0, 9))) for _ in range(300)]
    out = [(k, " ".join(random.choice(vocabulary) for _ in range(random.randint(0, 90)))) for k in range(700)]
    out += [(700, None), (701, ""), (702, "\n\t ..."), (703, "x" * 70 + " Y " + "z" * 300 + " a" * 30), (704, " ".join(vocabulary) * 20)]
    out += [out[5]] * 250 + [(5, "other text for the same number " * 9)] * 40 + [(None, "no number " * 30)] * 60
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def test_draw(spark, rows):
    items = [rows[9][1], rows[11][1], None, "", "of few words"]
    benchmark = spark.createDataFrame([(t,) for t in items], "text string")
    for percent in (5, 90):
        out = target.draw(table(spark, rows).repartition(5), benchmark, percent=percent)
        assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        same(out, brute_draw(rows, items, percent))


def test_draw_of_empty_tables(spark, rows):
    none = spark.createDataFrame([], "text string")
    assert target.draw(table(spark, []), none).count() == 0
    same(target.draw(table(spark, rows[:80]), none), brute_draw(rows[:80], []))


def test_hashes_of_runs_of_words():
    hashes = target.Hashes()
    text = b"a bb " + b"c" * 64 + b" " + b"d" * 1000 + b" e \xc3\xa9"
    found, of, counts = hashes.buckets([text, b"", b"one"], 1 << 32)
    w = text.split()
    want = [zlib.crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    assert Counter(found[of == 0].tolist()) == Counter(want) and counts.tolist() == [6, 0, 1]
    assert found[of == 2].tolist() == [zlib.crc32(b"one")]


def test_segments_are_regular(spark):
    """Ranks are those of one sort, however runs are dealt, and no segment is far above the mean."""
    from pyspark.sql import functions as F

    data = spark.range(0, 40_000, 1, 7).select((F.col("id") % 50).cast("long").alias("score"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"))
    out = target.ranked(data)
    got = [(r["score"], r["doc_id"]) for r in out.orderBy("rank").collect()]
    assert got == sorted(((k % 50, k) for k in range(40_000)), key=lambda x: (-x[0], x[1]))
    assert out.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first() == (1, 40_000, 40_000)
    samples = [(k % 50, k, 1, k, 1) for k in range(40_000)]
    cuts = target._splitters(samples, 16)
    keys = sorted(s[:4] for s in samples)
    sizes = np.diff([0, *(keys.index(c) for c in cuts), len(keys)])
    assert len(cuts) == 15 and sizes.max() - sizes.min() <= 1


def brute_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        told = [nearest(v)[1] for _, v in kept]
        at = [[sum(x) // len(m) for x in zip(*m)] if (m := [v for (_, v), t in zip(kept, told) if t == n]) else c for n, c in enumerate(at)]
    told = [nearest(v) for _, v in kept]
    by = Counter()
    for d, n in told:
        by[n] += d
    return [(i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, told)]


def vectors():
    random.seed(5)
    base = [[random.uniform(-2, 2) for _ in range(64)] for _ in range(9)]
    rows = [(k, [x + random.gauss(0, 0.2) for x in base[k % 9]]) for k in range(130)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("-inf")] + [0.0] * 63)]
    return rows + [rows[4]] * 40 + [(4, rows[7][1]), (None, rows[8][1]), (206, [0.0] * 64), (207, [1e4] * 64), (208, [-1e5] + [0.0] * 63)]


def test_centroids(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, __x string, distance int").repartition(3)
    same(centroids.cluster(df), brute_clusters(rows))
    same(centroids.cluster(df, centroids=3, rounds=8), brute_clusters(rows, 3, 8))
    few = rows[:7] + rows[130:136]
    same(centroids.cluster(df.where("vec_id < 7 OR vec_id BETWEEN 200 AND 205").dropDuplicates(["vec_id"])), brute_clusters([r for r in few]))
    assert centroids.cluster(df.where("vec_id IN (200, 203)")).count() == 0
    assert centroids.cluster(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_centroids_refuse_what_has_no_exact_distance(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no exact distances"):
        centroids.cluster(df)


def test_dot_products_change_by_changed_components():
    rng = np.random.default_rng(1)
    x, a = rng.integers(-(1 << 20), 1 << 20, (50, 64)), rng.integers(-(1 << 20), 1 << 20, (6, 64))
    b = a.copy()
    b[2, 5] += 9
    b[4] = rng.integers(-(1 << 26), 1 << 26, 64)
    exact = np.array([[sum(int(p) * int(q) for p, q in zip(v, c)) for c in b] for v in x])
    assert (centroids.moved(x, centroids.dots(x, a), b - a) == exact).all()


TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "The cat's <s> sat  on 3 mats!\n", "Über die Brücke É 中文 ok ▁x", "\x00‍😀😀 ﷽", "tab\tand\nline\n\n", "word" * 5000,
    " ".join(f"w{i % 977}" for i in range(20_000)), "<0x41> <unk> </s>",
]


def test_pieces_equal_the_library(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model())
    random.seed(7)
    texts = TEXTS + ["".join(random.choice("abcdeth ing ABC  \n\t019.,'é中😀▁<s>ß\x00") for _ in range(random.randint(0, 40))) for _ in range(600)]
    rows = [(k, t, "x", "x") for k, t in enumerate(texts)] + [(8, texts[8], "x", "x"), (None, "no number", "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(3)
    expected, spans = [], {}
    for k, t, *_ in rows:
        found = library.encode(t or "", return_type="proto")
        ids = [p.id for p in found.pieces]
        spans[k] = ids, [p.begin for p in found.pieces], [p.end for p in found.pieces]
        expected.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    out = pieces.encode(df)
    same(out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), expected)
    same(pieces.encode(df, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), expected)
    for r in out.collect():
        assert (r["ids"], r["starts"], r["ends"]) == spans[r["doc_id"]]
        assert r["span_bytes"] == sum(b - a for a, b in zip(r["starts"], r["ends"]))
    same(pieces.decode(out), [(k, library.decode(spans[k][0])) for k, *_ in rows])
    assert pieces.encode(df.limit(0)).count() == 0


def test_decoding_of_any_ids():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model())
    with open(pieces.default_model(), "rb") as f:
        codec = pieces.Codec(f.read())
    random.seed(2)
    for _ in range(3000):
        ids = [random.choice([random.randrange(32_000), random.randrange(259), 28705]) for _ in range(random.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize(("prefix", "squeeze"), [(True, True), (False, True), (True, False)])
def test_compiled_character_maps(rule, prefix, squeeze):
    """Normalised text and the source of every character of it, as the library has them."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = proto.NormalizerSpec()
    spec.ParseFromString(library.serialized_normalizer_spec())
    own = pieces.Normaliser(spec, [], False)
    random.seed(4)
    for _ in range(1500):
        text = "".join(random.choice("abc ABC   ﬁ①ｱﾞカ　é́ß…Σ™½¨­​\t\n가") for _ in range(random.randint(0, 14)))
        normal, places = own.run(text.encode())
        starts, at = {}, 0
        for n, c in enumerate(text):
            starts[at], at = n, at + len(c.encode())
        starts[at], ends = len(text), np.cumsum([0, *(len(c.encode()) for c in normal.decode())])
        want, offsets = library.normalize(text, with_offsets=True)
        assert (normal.decode(), [starts[int(places[e])] for e in ends]) == (want, list(offsets))


def test_pieces_kept_for_merging_and_pieces_never_split():
    """The heap and the scan agree; a piece marked unused gives way to its parts; a user's piece stays whole."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    sentencepiece = pytest.importorskip("sentencepiece")
    with open(pieces.default_model(), "rb") as f:
        content = f.read()
    codec = pieces.Codec(content)
    words = ["▁international", "▁aaaaaaaaaaaa", "▁éé中文", "▁▁▁▁x"]
    assert [codec.merge(w) for w in words] == [codec._merge_long(w) for w in words]
    spec = proto.ModelProto()
    spec.ParseFromString(content)
    for p in spec.pieces:
        if p.piece in ("▁the", "▁intern"):
            p.type = pieces.UNUSED
        if p.piece in ("ation", "▁of"):
            p.type = pieces.USER
    changed = pieces.Codec(spec.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    for text in ("the international nation of the others", "ationation  of", ""):
        ids, starts, ends = changed.encode(text)
        found = library.encode(text, return_type="proto")
        assert [(p.id, p.begin, p.end) for p in found.pieces] == list(zip(ids.tolist(), starts.tolist(), ends.tolist()))
        assert changed.shown(ids).decode() == library.decode(ids.tolist())
