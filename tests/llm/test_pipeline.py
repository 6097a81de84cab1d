"""The whole pipeline against a plain chain of its five stages, on a table with shared ids, nulls and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from skytally.llm import bpe, grade, langid
from skytally.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, source string, __key string, __row string, __id string, score string, kept string, component_id string, text_hash string"


def rows():
    random.seed(11)
    words = {"en": "the cat and a dog were seen with this house near old river town".split(), "de": "der hund und die katze sind nicht bei einem haus am alten fluss".split()}
    text = lambda lang, n: " ".join(random.choice(words[lang]) + random.choice(["", "s", "n", "t"]) for _ in range(n))
    out = [(k, text("en" if k % 2 else "de", random.randint(20, 60)), "en" if k % 2 else "de") for k in range(160)]
    out += [(k, "$$$ buy now ### " * 6 + text("en", 8), "en") for k in range(160, 200)]
    base = out[7][1]
    out += [(300, base, "en"), (300, base, "en"), (301, base + " end", "en"), (7, text("en", 40), "en"), (7, base, "en")]
    out += [(8, text("en", 20) + " seven little birds sang over nine green hills at dawn today " + text("en", 10), "en"), (None, text("en", 30), "en"), (None, text("de", 30), None)]
    return out + [(400, None, "en"), (401, "", "de"), (402, " \n", None), (403, "12 34 !!", "en")]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def chain(rows, docs, labels, item):
    model = langid.train(docs.where(remainder("doc_id", 5) != 0))

    def told(t):
        if t is None or not re.search(r"[^\W\d_]", t):
            return False
        bits = model.code_length(t.encode())
        return 1 / np.exp2(np.maximum(bits.min() - bits, -1000.0)).sum() >= corpus_pipeline.LEAST_SCORE

    rows = [r for r in rows if told(r[1])]
    kept = docs.sparkSession.createDataFrame([(*r, *[None] * 8) for r in rows], SCHEMA)
    graded = grade.train(kept, labels, grade.quality_and_toxicity())
    rows = [r for r in rows if graded is None or (f := grade.features(r[1])) and graded.above(f)[1] >= 0.5]
    sets = []
    for _, t, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        key = (r[0] is None, r[0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = key, r
    rows = [r for _, r in best.values()]
    window = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    w = window(item)
    grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    return [r for r in rows if not any(tuple(window(r[1])[i : i + 10]) in grams for i in range(len(window(r[1])) - 9))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = "Seven little birds sang over nine green hills at dawn today"
    data = rows()
    docs = spark.createDataFrame([(*r, *[None] * 8) for r in data], SCHEMA)
    labels = spark.createDataFrame([(k, int(k < 160), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, data, spark.read.parquet(f"{path}/documents.parquet"), labels, item


def test_run_equals_a_plain_chain(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    path, data, docs, labels, item = folder
    known = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    expected = []
    for k, t, _ in chain(data, docs, labels, item):
        ids = known.encode(t, add_special_tokens=False).ids
        expected.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, path).collect()]
    # Of equal doc_ids in a group either text may stay; the fixture has such a group of equal texts only.
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert 0 < len(got) < len(data) and {8, None} <= {k for k, _, _ in got} and sum(k == 7 for k, _, _ in got) == 2


def test_rows_of_one_id_are_judged_each_by_its_text(spark, folder):
    path, data, *_ = folder
    clean = data[1][1]
    docs = spark.createDataFrame([("x", clean, 1), ("x", "seven little birds sang over nine green hills at dawn today", 2), (None, clean + " more", 3)], "doc_id string, text string, __key int")
    assert [r["__key"] for r in corpus_pipeline.decontamination(spark, docs, path).orderBy("__key").collect()] == [1, 3]
    assert sorted(r["__key"] for r in corpus_pipeline.near_duplicates(spark, docs, path).collect()) == [1, 2]
    none = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", " ", 3)], docs.schema)
    assert corpus_pipeline.near_duplicates(spark, none, path).count() == 3


def test_groups_are_planned_once(spark, folder):
    path, _, docs, *_ = folder
    out = corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 40"), path)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The tables of the operator itself (names, component labels) are not in the plan of the stage's result.
    assert plan.count("n_shingles") == 0 and plan.count("__group") > 0


def test_an_empty_table(spark, folder, tmp_path):
    path, _, docs, labels, _ = folder
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
