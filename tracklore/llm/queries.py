"""Queries opN_<name>: each applies one operator, with production parameters, to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm.bpe import bpe_round_trip
from tracklore.llm.common import read_table
from tracklore.llm.fingerprint import edited_and_next
from tracklore.llm.hnsw import near_vectors
from tracklore.llm.jaccard import jaccard_groups
from tracklore.llm.language import language_id, page_fields
from tracklore.llm.negatives import hard_negatives
from tracklore.llm.packing import pack_documents
from tracklore.llm.periodic import periodic_runs, run_digests, with_periodic_tails
from tracklore.llm.quality_model import quality_scores
from tracklore.llm.quality_rules import quality_rules
from tracklore.llm.sharding import shard
from tracklore.llm.substring import substring_dedup
from tracklore.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), least=0.98)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(page_fields(read_table(spark, sf_dir, "pages", "page_id", "url", "html")), read_table(spark, sf_dir, "documents", "lang", "text"))
    return found.withColumnRenamed("id", "page_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), whole=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents", "doc_id", "text"), 24)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents", "doc_id", "text"), length=50, whole=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "toxic")).drop("features")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label).withColumn("anchor", F.col("vec_id") % 50 == 0), scale=256.0, positives=5, negatives=3, low=50, high=95)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_periodic_tails(read_table(spark, sf_dir, "documents", "doc_id", "text")), least=12, whole=False))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, d.vec_id = m.c AS kept
FROM embeddings d LEFT JOIN n ON n.a = d.vec_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.vec_id
""",
    "op7_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(a) < 5 THEN array_to_string(a, ' ') ELSE array_to_string(a[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
""",
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(a[i : i + 49], ' ')) AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS i FROM w WHERE len(a) >= 50)),
f AS (SELECT g, min(doc_id) AS d FROM x GROUP BY g),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT x.doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN f USING (g) WHERE d < x.doc_id)),
t AS (SELECT doc_id, unnest(a) AS v, unnest(range(1, len(a) + 1)) AS j FROM w),
k AS (SELECT t.doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY j) AS s FROM t ANTI JOIN c ON c.doc_id = t.doc_id AND c.j = t.j GROUP BY t.doc_id)
SELECT w.doc_id, len(a) AS n_words, len(a) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""",
    "op6_quality_rules": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (SELECT doc_id, i, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM w WHERE len(a) >= 3)),
d AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g JOIN d USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS k FROM l),
h AS (SELECT host, count(DISTINCT text) AS t FROM w GROUP BY host),
b AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS n FROM k GROUP BY host, k) JOIN h USING (host) WHERE n >= 3 AND n > 0.10 * t OR n >= 10000),
u AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l GROUP BY doc_id),
x AS (SELECT doc_id, sum(n)::BIGINT AS n FROM k JOIN b USING (host, k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(a) AS n_words, length(array_to_string(a, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS boilerplate_words
  FROM w LEFT JOIN u ON u.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN x ON x.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * boilerplate_words <= n_words AND n_words - boilerplate_words >= 50 AS kept FROM m
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.score AS p, s.b AS n, s.score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, r::INTEGER AS rank, n AS negative_id, p AS positive_score, score AS negative_score FROM n WHERE r <= 3
""",
    "op12_periodic_runs": r"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM c),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
x AS (SELECT doc_id, unnest(w) AS v, unnest(range(n)) AS i FROM t),
p AS (SELECT x.doc_id, y.i - x.i AS d, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.v = y.v AND x.i < y.i),
l AS (SELECT doc_id, d, min(i) AS s, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM p) GROUP BY doc_id, d, k),
r AS (SELECT doc_id, s, c + d AS length, min(d) AS q FROM l WHERE c >= greatest(12 - d, d) GROUP BY doc_id, s, c + d),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, s, q) = 1),
f AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS f FROM r GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS k FROM x ANTI JOIN o USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(f.n, 0) AS n_runs, b.s AS start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
  sha256(coalesce(f.f, '')) AS runs_sha256, sha256(coalesce(k.k, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN f ON f.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
""",
}
