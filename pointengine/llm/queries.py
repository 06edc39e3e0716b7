"""Queries of this subpackage's operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, ctw, dual_tree, fill_middle, line_crf, near_dedup, nn_descent, piece_scan, quality_pu, suffix_dedup, toxicity_fm
from .packing import pack
from .sharding import shard_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_crf.rule_documents(docs, line_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_documents(_table(spark, sf_dir, "documents"))


def op4_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_fm.score_documents(docs, toxicity_fm.fit(docs, _table(spark, sf_dir, "labels")))


def op6_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_scan.digest(_table(spark, sf_dir, "documents"), piece_scan.Vocabulary.load(piece_scan.MODEL))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_pu.score_documents(docs, quality_pu.fit(docs, _table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(_table(spark, sf_dir, "documents"))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest(_table(spark, sf_dir, "documents"), byte_bpe.ByteBpe.load(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf": op1_line_crf,
    "op2_nn_descent": op2_nn_descent,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_icws_near_dedup": op4_icws_near_dedup,
    "op5_toxicity_fm": op5_toxicity_fm,
    "op6_piece_scan": op6_piece_scan,
    "op7_pu_quality": op7_pu_quality,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_ctw": op10_ctw,
    "op11_fill_middle": op11_fill_middle,
    "op12_dual_tree": op12_dual_tree,
    "op13_byte_bpe": op13_byte_bpe,
}

#: Every 50-byte window in hex, the least document that holds it, the runs that later ones lose, and what is left of each text.
SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT rid, doc, b, substr(x, 2 * b + 1, 1098) AS y FROM (SELECT rid, doc, x, unnest(range(0, length(x) // 2, 500)) AS b FROM d)),
windows AS (SELECT rid, doc, b + j AS p, substr(y, 2 * j + 1, 100) AS w FROM (SELECT rid, doc, b, y, unnest(range(0, least(500, length(y) // 2 - 49))) AS j FROM blocks)),
least_doc AS (SELECT w, min(doc) AS m FROM windows GROUP BY w HAVING min(doc) < max(doc)),
hit AS (SELECT rid, p FROM windows JOIN least_doc USING (w) WHERE doc > m),
turn AS (SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 50, true) AS new FROM hit),
island AS (SELECT rid, p, sum(new::INT) OVER (PARTITION BY rid ORDER BY p) AS k FROM turn),
runs AS (SELECT rid, k, min(p) AS s, max(p) + 50 AS e FROM island GROUP BY rid, k),
gaps AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS f FROM runs),
cut AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS z, string_agg(substr(x, 2 * f + 1, 2 * (s - f)), '' ORDER BY s) AS kept FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""

#: Places of the cuts from the digest's groups; texts are cut and put together by code points.
FILL_MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                   ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""

#: Every anchor against every row, whole numbers throughout.
HARD_NEGATIVE_SQL = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      [CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, e.rid, e.vec_id, e.label = a.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
      FROM e a JOIN e ON a.rid <> e.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
      CAST(row_number() OVER (PARTITION BY p.arid, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INT) AS "rank"
      FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 10
"""

#: The histogram, the least padding of its first bins for 1 to 16 buckets, the boundaries from the last one back, and rows by MD5.
PACKING_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS n_tokens, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS o FROM documents),
p AS (SELECT n_tokens, length(bin(n_tokens)) - 1 AS e FROM d),
b AS (SELECT n_tokens, CASE WHEN n_tokens <= 8192 THEN n_tokens ELSE 8192 + e * 256 + CAST(floor((n_tokens - pow(2, e)) / pow(2, e) * 256) AS BIGINT) END AS b FROM p),
g AS (SELECT b, max(n_tokens) AS l, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS t FROM b GROUP BY b),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b) AS j, l, CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS n, CAST(sum(t) OVER (ORDER BY b) AS BIGINT) AS t FROM g),
f(k, j, v) AS (SELECT 1, j, l * n - t FROM h UNION ALL
  SELECT f.k + 1, h.j, min(CASE WHEN f.j = h.j THEN f.v ELSE f.v + h.l * (h.n - i.n) - (h.t - i.t) END) FROM f JOIN h i ON i.j = f.j JOIN h ON h.j >= f.j WHERE f.k < 16 GROUP BY f.k, h.j),
m AS MATERIALIZED (SELECT j, v, min(k) AS k FROM f GROUP BY j, v),
back(k, j, v) AS (SELECT k, j, v FROM m WHERE j = (SELECT max(j) FROM h) AND v = (SELECT min(v) FROM f WHERE j = (SELECT max(j) FROM h)) UNION ALL
  SELECT m.k, m.j, m.v FROM (SELECT min(f.j) AS j, arg_min(f.v, f.j) AS v FROM back JOIN h ON h.j = back.j JOIN f ON f.k = back.k - 1 AND f.j < back.j JOIN h i ON i.j = f.j
                             WHERE f.v + h.l * (h.n - i.n) - (h.t - i.t) = back.v) x JOIN m ON m.j = x.j AND m.v = x.v),
bounds AS (SELECT CAST(row_number() OVER (ORDER BY l) - 1 AS INT) AS bucket, l AS boundary, coalesce(lag(l) OVER (ORDER BY l), -1) AS below FROM back JOIN h USING (j)),
r AS (SELECT doc_id, n_tokens, bucket, boundary, greatest(65536 // boundary, 1) AS fit, row_number() OVER (PARTITION BY bucket ORDER BY o) - 1 AS place
      FROM d JOIN bounds ON n_tokens <= boundary AND n_tokens > below)
SELECT doc_id, n_tokens, bucket, boundary, CAST(place // fit AS BIGINT) AS batch, CAST(place % fit AS INT) AS slot FROM r
"""

ORACLE_SQL: dict[str, str] = {"op8_packing": PACKING_SQL, "op3_suffix_dedup": SUFFIX_SQL, "op11_fill_middle": FILL_MIDDLE_SQL, "op12_dual_tree": HARD_NEGATIVE_SQL}
