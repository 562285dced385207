"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coinstrata.llm._common import tables
from coinstrata.llm.bpe import encode_digests
from coinstrata.llm.exact_dedup import exact_dedup
from coinstrata.llm.jaccard_join import near_groups
from coinstrata.llm.language_id import identify
from coinstrata.llm.license_scan import oracle as license_oracle
from coinstrata.llm.license_scan import scan_licenses
from coinstrata.llm.packing import pack_documents
from coinstrata.llm.scaled_sketch import compare_edited
from coinstrata.llm.secrets import find_secrets
from coinstrata.llm.suffix_tree import score_texts
from coinstrata.llm.url_rules import filter_urls


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(tables(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(tables(spark, sf_dir, "documents"))


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(tables(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(tables(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(tables(spark, sf_dir, "pages"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(tables(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(tables(spark, sf_dir, "documents"))


def op8_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(tables(spark, sf_dir, "documents"))


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(tables(spark, sf_dir, "documents"))


def op10_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(tables(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_tree, op2_exact_dedup, op3_scaled_sketch, op4_jaccard_join, op5_url_rules, op6_bpe_tree, op7_language_id, op8_tier_packing, op9_license_diagonals, op10_secret_battery, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                   count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents""",
        "op4_jaccard_join": r"""
            WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM split),
            each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
            pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
            links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
            ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach(doc_id, other) AS (SELECT a, b FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
            SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
            FROM sets s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""",
        "op9_license_diagonals": license_oracle(),
    }
