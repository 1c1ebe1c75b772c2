"""The corpus operators' queries over the standard tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, licences, maxent, media, negatives, personal, phrases, pieces, quality, secrets, tokenfile
from .tables import read

#: DuckDB: ASCII-lower-cased text and its words
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+')"


def op1_html_extraction(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages")).drop("n_blocks")


def op2_media_columns(spark, sf_dir):
    return media.read_texts(media.store_texts(read(spark, sf_dir, "documents"))).drop("clips", "error")


def op3_quality_classifier(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op4_token_id_output(spark, sf_dir, tokenizer: str | None = None):
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return tokenfile.read_tokens(spark, tokenfile.write_tokens(read(spark, sf_dir, "documents"), path, 2))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_license_scan(spark, sf_dir):
    found = licences.license_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


SQL_7 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
  FROM t),
n AS (SELECT t.doc_id, count(s.g) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * m >= 80 * (nx.n + ny.n - m)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, c.component_id
FROM n JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


def op8_sentencepiece(spark, sf_dir, model: str | None = None):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode_texts(docs, model or public_tokenizers.path("piece_bpe_32k.model")))


def op9_lm_scoring(spark, sf_dir):
    return maxent.maxent_scores(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.findings(secrets.secret_scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.expr("IF(vec_id % 7 = 0, (cast(label as bigint) + 1) % 10, label)"))
    return negatives.hard_negatives(rows, "vec_id % 50 = 0")


SQL_11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS s
  FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (
  SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same WHERE 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_pii(spark, sf_dir):
    return personal.findings(personal.pii_scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_phrase_collocation(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))


SQL_13 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (
  SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f AS o WHERE o.lang = f.lang AND o.k > f.k AND 100 * o.f >= 100 * f.f AND contains(' ' || o.phrase || ' ', ' ' || f.phrase || ' '))),
t AS (SELECT c.*, unnest(range(1, c.k)) AS cut, string_split(phrase, ' ') AS w FROM c),
s AS (
  SELECT t.lang, t.phrase, t.a, x.f AS l, y.f AS r, n.n, cut, 1000 * t.a::HUGEINT * n.n::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM t JOIN f AS x ON x.lang = t.lang AND x.phrase = array_to_string(w[:cut], ' ')
  JOIN f AS y ON y.lang = t.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = t.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM b)
SELECT * FROM z WHERE rank <= 2000
"""


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_media_columns": op2_media_columns,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_id_output": op4_token_id_output,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op10_secret_scan": op10_secret_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_lm_scoring": op9_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_pii": op12_pii,
    "op13_phrase_collocation": op13_phrase_collocation,
}

SQL = {
    "op7_ngram_jaccard_join": SQL_7,
    "op11_hard_negatives": SQL_11,
    "op13_phrase_collocation": SQL_13,
}
