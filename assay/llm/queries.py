"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import bpe, langid, licenses, packing, simhash, sketch, suffix, topk, toxicity, urlfilter

#: Names of installed vocabulary files.
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Host, path and verdict of the URL rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of those not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that every document names."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of each hundredth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 100 bytes that came earlier."""
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and of its edited text."""
    return sketch.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a chain fitted on a sample of the labelled ones."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_license_scans": op4_license_scans,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_toxicity": op10_toxicity,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op3_url_filters": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut)
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) = 1""",
    "op6_exact_top_k": """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}
