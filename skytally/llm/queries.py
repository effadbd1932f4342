"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .centroids import cluster_vectors
from .common import documents
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .line_dedup import dedup_lines
from .minhash_dedup import near_duplicates
from .pieces import encode_pieces
from .pii import find_pii, pii_report
from .quality import score_quality
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_files import read_tokens, token_folder, write_tokens
from .toxicity import score_toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substring_dedup(documents(spark, sf_dir), window=13).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(find_pii(documents(spark, sf_dir)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item it holds a copy of; clean documents have none."""
    ship_package(spark)
    leaks = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", F.round("score", 6).alias("score"), "first_word", "end_word")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_duplicates(documents(spark, sf_dir), shingle=5, percent=75)


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return encode_pieces(documents(spark, sf_dir)).select("doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spelling_variants(documents(spark, sf_dir), least=7, every=31, least_n=2, times=10)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    folder = token_folder(spark)
    write_tokens(documents(spark, sf_dir), folder)
    return read_tokens(spark, folder, ids=False)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), clusters=16, rounds=3, dims=64, scale=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_piece_encoding": op10_piece_encoding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_files": op12_token_files,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), firsts AS (
  SELECT win, min(doc_id) AS first_id FROM starts GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
  FROM starts JOIN firsts USING (win) WHERE first_id < doc_id
), lists AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN coalesce(array_to_string(ws, ' '), '')
              ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ks, k)), lambda k: ws[k]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op9_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM (SELECT a.doc_id, b.doc_id AS other, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.doc_id JOIN n y ON y.doc_id = p.other WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS label FROM documents
  UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node WHERE r.label < l.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(label) AS component_id, d.doc_id = min(label) AS kept
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
""",
    "op11_spelling_variants": """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, CAST(i AS UBIGINT) AS c FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END FROM bits WHERE step < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS UBIGINT)] ELSE [CAST(192 + ord(ch) // 64 AS UBIGINT), CAST(128 + ord(ch) % 64 AS UBIGINT)] END))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]))) AS h FROM runs, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), less AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, CASE WHEN m >= 10 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS root, form FROM forms
  UNION ALL SELECT r.word, f.word, f.form FROM roots r JOIN forms f ON f.word = r.form
)
SELECT forms.word, forms.form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM roots WHERE form IS NULL) USING (word)
""",
    "op13_centroid_clustering": """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), vectors AS MATERIALIZED (SELECT r, vec_id, unnest(range(1, 65)) AS j, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT k, unnest(range(1, 65)) AS j, unnest(v) AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < 16),
a0 AS MATERIALIZED (
  SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM vectors JOIN c0 USING (j) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
),
c1 AS MATERIALIZED (
  SELECT k, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM c0 LEFT JOIN (SELECT k, j, sum(x) AS s, count(*) AS n FROM vectors JOIN a0 USING (r) GROUP BY k, j) USING (k, j)
),
a1 AS MATERIALIZED (
  SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM vectors JOIN c1 USING (j) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
),
c2 AS MATERIALIZED (
  SELECT k, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM c1 LEFT JOIN (SELECT k, j, sum(x) AS s, count(*) AS n FROM vectors JOIN a1 USING (r) GROUP BY k, j) USING (k, j)
),
a2 AS MATERIALIZED (
  SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM vectors JOIN c2 USING (j) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
),
c3 AS MATERIALIZED (
  SELECT k, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM c2 LEFT JOIN (SELECT k, j, sum(x) AS s, count(*) AS n FROM vectors JOIN a2 USING (r) GROUP BY k, j) USING (k, j)
),
a3 AS MATERIALIZED (
  SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM vectors JOIN c3 USING (j) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN kept USING (r) JOIN (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY k) USING (k)
""",
}
