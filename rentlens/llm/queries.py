"""The registered training-data queries: thin, each one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, fingerprints, hard_negatives, licenses, metric_join, mixing, ngram_jaccard, packing, phrases, substring_dedup, subword_quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(_table(spark, sf_dir, "conversations"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_groups(_table(spark, sf_dir, "documents")).drop("key", "mark")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(_table(spark, sf_dir, "documents")))


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_fingerprints": op2_fingerprints,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op4_mixing": op4_mixing,
    "op6_packing": op6_packing,
    "op9_license_scan": op9_license_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_phrase_collocation": op11_phrase_collocation,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op1_chat_format": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |')
         || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS s FROM t GROUP BY conv_id)
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, s AS text FROM c
WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.n > c.n AND starts_with(d.s, c.s)) GROUP BY n, s""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT t.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(t.vec_id, coalesce(r.b, t.vec_id)) AS component_id,
       t.vec_id <= coalesce(r.b, t.vec_id) AS kept
FROM embeddings t LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = t.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = t.vec_id""",
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM inter JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * m >= 80 * (s.n + t.n - m)),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id)) AS component_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM w LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = w.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = w.doc_id""",
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS win FROM starts),
repeats AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY win) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM repeats),
words AS (
  SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS j FROM w),
kept AS (
  SELECT a.doc_id, count(*) AS n_kept, string_agg(a.word, ' ' ORDER BY a.j) AS text
  FROM words a LEFT JOIN gone b ON a.doc_id = b.doc_id AND a.j = b.j WHERE b.j IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)""",
    "op11_phrase_collocation": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT id, lang, unnest(words) AS x, unnest(generate_series(1, len(words))) AS i FROM w),
g AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM s WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, x AS phrase, x AS first1, NULL AS rest1, NULL AS first2, NULL AS rest2, count(*) AS f FROM g GROUP BY lang, x
  UNION ALL SELECT lang, 2, x || ' ' || y, x, y, NULL, NULL, count(*) FROM g WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, x, y || ' ' || z, x || ' ' || y, z, count(*) FROM g WHERE z IS NOT NULL GROUP BY lang, x, y, z),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
u AS (
  SELECT lang, phrase, max(f) AS over FROM (
    SELECT lang, first2 AS phrase, f FROM c WHERE k = 3
    UNION ALL SELECT lang, rest1 AS phrase, f FROM c WHERE k = 3) GROUP BY ALL),
parts AS (
  SELECT lang, phrase, f AS a, 1 AS k, first1 AS head, rest1 AS tail FROM c UNION ALL SELECT lang, phrase, f, 2, first2, rest2 FROM c WHERE k = 3),
cuts AS (
  SELECT t.lang, t.phrase, t.a, t.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * t.a * t.a) // (l.f::HUGEINT * r.f)) AS score
  FROM parts t JOIN f l ON l.lang = t.lang AND l.phrase = t.head JOIN f r ON r.lang = t.lang AND r.phrase = t.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT best.*, n.n FROM best JOIN n ON n.lang = best.lang LEFT JOIN u ON u.lang = best.lang AND u.phrase = best.phrase
  WHERE u.over IS NULL OR 100 * u.over < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op12_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (
  SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
