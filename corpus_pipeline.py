"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret scans, packing; each stage reads what the one before kept.

Null texts count as empty ones and fail the quality rules. The stages that compare documents tell rows apart by a number of their own where a doc_id is
missing or repeated, so such rows are judged by their texts like all others, and go only if their text is that of a row that stays, or nearly so.
Empty tables give empty tables; columns beside doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcodec.llm import exact_dedup, minhash, packing, quality_rules, secrets, tokens
from semcodec.llm.common import columns, compact, drop, materialize, numbered, temporary_tables, without


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a fixed limit or that the forest rejects go."""
    forest, threshold = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compact(quality_rules.filtered(docs, forest, threshold))


def _by_number(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), "text")


def _deduplicated(docs: DataFrame, find) -> DataFrame:
    """docs without the rows that find(doc_id, text) doesn't keep."""
    rows, key = numbered(docs)
    return compact(without(rows, key, find(_by_number(rows, key)).where("not kept").select("doc_id")).select(*columns(docs)))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return _deduplicated(docs, exact_dedup.exact_duplicates)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies stays."""
    return _deduplicated(docs, minhash.near_duplicates)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text; every document stays."""
    rows, key = numbered(docs)
    found = secrets.scan(rows.select(F.col(key).alias("doc_id"), "text", "source", "lang"))
    clean = secrets.redacted(rows, found, key=key).select(*columns(docs))
    return compact(clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", _quality), ("exact_dedup", _exact), ("minhash", _near), ("secrets", _secrets), ("packing", _packed)]

#: No SQL: the fitted forest and the packing of tokens can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary_tables() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        if name != STAGES[0][0]:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
