"""The corpus pipeline: documents in, packed sequences out, each stage on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinstrata.llm._common import materialize, small_side
from coinstrata.llm.exact_dedup import keep_one
from coinstrata.llm.jaccard_join import near_groups
from coinstrata.llm.language_id import keep_accepted
from coinstrata.llm.packing import pack_documents
from coinstrata.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: without letters, or with no language likely.

    So null and empty texts go.  Null or repeated ids don't matter: each row is judged by its text.  No rows give no rows.
    """
    return keep_accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of equal texts: the row with the largest id, a null one only where there is no other.

    A null text counts as empty; of rows that also share the id any one stays.  Rows go by id and text together.
    """
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near duplicates: the least id, a null one only where there is no other.

    Rows are known by their text's hash, as no two of them have equal texts here; ids may be null or repeat, and of equal ids
    the least hash stays.  Null, empty and white texts are near to nothing and stay.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    groups = near_groups(docs.select(key.alias("key"), "text"), id_col="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("root"))
    others = materialize(groups.filter("key <> root").distinct())
    members = others.union(others.select("root", "root").distinct())
    ids = docs.select("doc_id", key.alias("key")).join(small_side(members), "key")
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    gone = materialize(members.join(best, "root").filter("key <> best.key").select(F.col("key").alias("_gone")))
    return docs.join(small_side(gone), key == F.col("_gone"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts; no document goes.  A null text stays null; the length column follows the text."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows, a row a piece; a null or empty text is its end alone."""
    return pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packing)]

#: The language model, the randomness battery and the tokenizer can't be written in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
