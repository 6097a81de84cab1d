"""Registered queries of this subpackage, each over its whole table with production parameters, and their checking SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally import session
from skytally.llm import bpe, centroids, decontam, grade, jaccard, langid, licenses, lmscore, pieces, rules, sharding, target, warc
from skytally.llm.common import table

SHARDS = 24


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session.checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = warc.convert(warc.write_arc(table(spark, sf_dir, "pages")), path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session.checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, store=path)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op10_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade.grade_documents(docs, grade.train(docs, table(spark, sf_dir, "labels"), grade.quality_and_toxicity()))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), ids=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_language, op3_rules, op4_licenses, op5_warc, op6_sharding, op7_jaccard, op8_decontamination, op9_lm_score,
        op10_grade, op11_target_resampling, op12_centroids, op13_sentencepiece,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKEN = r"[^\x20\x09-\x0D]+"


def _centroid_sql(centroids: int = 40, rounds: int = 5) -> str:
    """Every round computes all distances anew."""
    nearest = """
SELECT r, vec_id, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT r, vec_id, x, k, CAST(list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS BIGINT) AS d FROM v, c{0}
) GROUP BY r, vec_id, x"""
    move = """
SELECT c{0}.k, coalesce(m.c, c{0}.c) AS c FROM c{0} LEFT JOIN (
  SELECT k, list(y ORDER BY j) AS c FROM (
    SELECT k, j, CAST((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS y FROM a{0}, range(1, 65) t(j) GROUP BY k, j
  ) GROUP BY k
) m ON m.k = c{0}.k"""
    parts = [
        """v AS MATERIALIZED (
SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INT) AS k, x AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {centroids})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED ({nearest.format(n)})")
        if n < rounds:
            parts.append(f"c{n + 1} AS MATERIALIZED ({move.format(n)})")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


ORACLE = {
    "op12_centroids": _centroid_sql(),
    "op5_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT hex, payload_bytes, min(page_id) AS first FROM p GROUP BY ALL)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((('0x' || substr(p.hex, 1 + 10 * (i // 8), 10))::BIGINT) >> (5 * (7 - i % 8))) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f ON p.hex = f.hex AND p.payload_bytes = f.payload_bytes""",
    "op7_jaccard": f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TOKEN}') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0 AND item IS NOT NULL)
), s AS (SELECT DISTINCT size FROM v),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (
  SELECT p.doc_id, p.i, s.size, v.item FROM p JOIN s ON p.i + s.size - 1 <= len(p.w)
  JOIN v ON v.size = s.size AND v.gram = array_to_string(p.w[p.i:p.i + s.size - 1], ' ')
), h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(k.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op3_rules": f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS w FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) > 4)
), r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS at FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_capitals, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM t LEFT JOIN r ON r.doc_id = t.doc_id
), f AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), s AS (
  SELECT doc_id, lang, base_failed, 'symbols' AS rule, least(100, 100 * n_symbols // greatest(1, word_chars)) AS share FROM f
  UNION ALL SELECT doc_id, lang, base_failed, 'dup_lines', least(100, 100 * n_dup_lines // greatest(1, n_lines)) FROM f
  UNION ALL SELECT doc_id, lang, base_failed, 'repeats', least(100, 100 * n_repeat_words // greatest(1, n_words)) FROM f
  UNION ALL SELECT doc_id, lang, base_failed, 'capitals', least(100, 100 * n_capitals // greatest(1, word_chars)) FROM f
), y AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT lang, rule, share, count(*) FILTER (good <> 0) AS good, count(*) FILTER (good = 0) AS poor FROM s JOIN y USING (doc_id) WHERE NOT base_failed GROUP BY ALL
), k AS (
  SELECT lang, rule, share AS cutoff, sum(good) OVER (PARTITION BY lang, rule) AS n,
    coalesce(sum(good) OVER (PARTITION BY lang, rule ORDER BY share DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
    coalesce(sum(poor) OVER (PARTITION BY lang, rule ORDER BY share DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught FROM c
), q AS (
  SELECT *, k < n * 0.0025 AND coalesce(list_sum(list_transform(range(0, CAST(CASE WHEN k < n * 0.0025 THEN k ELSE -1 END AS BIGINT) + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0025) + (n - i) * ln(1 - 0.0025)))), 1) <= 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM c)) AS pass FROM k
), z AS (
  SELECT lang, rule, arg_max(cutoff, {{'gain': caught - k, 'cutoff': cutoff}}) AS cutoff
  FROM (SELECT *, bool_and(pass) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS ok FROM q) WHERE ok AND caught > k GROUP BY lang, rule
), j AS (SELECT DISTINCT s.doc_id FROM s JOIN z ON s.rule = z.rule AND s.lang IS NOT DISTINCT FROM z.lang WHERE s.share > z.cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM j) AS kept FROM f""",
}
