"""The registered queries of the package, with SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.llm import fingerprints, language, licenses, media, merkle, mixing, packing, pii, prefixes, quality, simhash, substrings, tokens
from cohortline.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("found")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_scan(table(spark, sf_dir, "documents")).drop("found")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


SUBSTRINGS_SQL = r"""
WITH parted AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS MATERIALIZED (SELECT rid, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM parted),
windows AS MATERIALIZED (
  SELECT rid, p, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS w FROM placed),
counted AS (SELECT rid, p, count(*) OVER (PARTITION BY w) AS times FROM windows WHERE p <= n - 34),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS p FROM counted WHERE times > 1),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM placed ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM parted LEFT JOIN kept USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_simhash, op3_token_counts, op4_language, op5_mixing, op6_substrings, op7_packing,
                            op8_quality, op9_media, op10_licenses, op11_pii, op12_merkle, op13_prefixes)}
SQL: dict[str, str] = {"op5_mixing": mixing.MIX_SQL, "op6_substrings": SUBSTRINGS_SQL, "op12_merkle": merkle.MANIFEST_SQL, "op13_prefixes": prefixes.TRIE_SQL}
