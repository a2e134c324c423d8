"""A training-corpus pipeline of five stages over the `documents` table.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame.  A stage's
rows are written as Parquet and read back as the next one's docs, so lineage ends between
stages and a lost executor costs one stage's tasks at most.  All stages but the last return
the columns of documents.

Defined cases, of every stage: an empty table gives an empty one; rows that come twice are judged alike and stay or go
together; rows of null ids are judged by their texts, but for near-dedup, which keeps them all; texts of any length are read whole; further columns are kept,
whatever their names, by all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import byte_bpe, decontaminate, language_id, near_dedup, secret_scan
from quillon.llm.runtime import documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null ones, those without a letter, and those that no language's text can parse in phrases of some length."""
    return language_id.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of least id; null and empty texts are in no class with others."""
    return near_dedup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null and empty texts and items have none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, overlapping ones as one; no document goes, and a null text stays null."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the bytes they decode to; a null text has no ids."""
    return byte_bpe.digests(byte_bpe.encode(docs, round_trip=True), "doc_id", "lang", "source", "n_chars", "ids")


STAGES = [("language ID", language), ("near-dedup", near_duplicates), ("decontamination", decontamination), ("secret scan", secrets), ("byte-level BPE", tokens)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
