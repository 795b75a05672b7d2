"""The registered query of each operator, (spark, sf_dir) -> DataFrame, over the whole table with production parameters."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import hash_tree
from archivolt.llm.hash_tree import shard_documents
from archivolt.llm.host_quality import host_quality
from archivolt.llm.license_scan import scan_licenses
from archivolt.llm.mixing import mix_sources
from archivolt.llm.orc_tokens import OrcTokens, tokens_of
from archivolt.llm.pii_crf import find_personal_data
from archivolt.llm.piece_lattice import Lattice, round_trip
from archivolt.llm.pivot_index import near_vectors
from archivolt.llm.probminhash import near_duplicates
from archivolt.llm.secret_scan import scan_secrets

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(documents(spark, sf_dir).select("doc_id", "text"), Lattice(PIECES), keep=["doc_id"])
    return found.select("row.doc_id", "n_pieces", "ids_crc32", "lossless")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(documents(spark, sf_dir), OrcTokens(public_tokenizers.path("byte_bpe_50k.json")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "tokens", "pass", "block")


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_quality(documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id", "source"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("row.source").alias("host"), "verdict")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "licenses", "spans", "containment")


def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_piece_sampling, op3_near_duplicates, op4_hash_tree, op5_orc_tokens, op6_secrets, op7_mixing, op8_host_quality, op9_licenses, op10_pivot_index, pipeline)}

HOST_SQL = """
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    p AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM t WHERE n > 1) GROUP BY doc_id),
    m AS (SELECT d.doc_id, source AS host, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN p ON d.doc_id = p.doc_id),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS soft_failed FROM m),
    h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft_failed) AS DOUBLE) AS failed FROM f GROUP BY host),
    a AS (SELECT sum(failed) / sum(n) AS m, (sum(failed * failed / n) - sum(failed) * sum(failed) / sum(n)) AS s, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, count(*) - 1 AS more FROM h),
    r AS (SELECT m, CASE WHEN room > 0 AND s / nullif(m * (1 - m), 0) - more > 0 THEN least((s / (m * (1 - m)) - more) / room, 1.0) END AS rho FROM a),
    q AS (SELECT m, coalesce(least(greatest(1 / rho - 1, 1.0), 1000.0), 1000.0) AS strength FROM r),
    v AS (SELECT host, CASE WHEN (failed + m * strength) / (n + strength) > 0.8 THEN 'blocked' WHEN (failed + m * strength) / (n + strength) > 0.5 THEN 'suspect' ELSE 'trusted' END AS verdict FROM h, q)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR verdict = 'blocked' OR (verdict = 'suspect' AND soft_failed)) AS kept, f.host, verdict FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

#: Exact cosines of all pairs: right for the small tables it runs on.
VECTOR_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT vec_id, e, list_bool_or(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x))) IS NOT TRUE AND len(e) > 0 AND sqrt(list_dot_product(e, e)) > 0 AS ok FROM v),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
    SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.reach) AS component_id, min(r.reach) = v.vec_id AS kept FROM v JOIN r ON r.node = v.vec_id GROUP BY v.vec_id
"""

#: Where DuckDB SQL can say the same; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op4_hash_tree": hash_tree.oracle(), "op8_host_quality": HOST_SQL, "op10_pivot_index": VECTOR_SQL}
