"""From documents to packed sequences: language ID, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. All but the last return the columns of documents. A stage works on all rows that it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm.common import materialize, table
from refloom.llm.decontam import without_leaks
from refloom.llm.langid import keep_identified
from refloom.llm.neardup import without_near_duplicates
from refloom.llm.packing import pack_documents
from refloom.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no text, no letter, or words that no language explains."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays: similarity 0.8 or more on
    shingles of five words. Rows without an id and different texts under one id count as documents."""
    return without_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark, and n_chars follows."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; see the packing operator."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]

ORACLE_SQL = None  # learned stages; tests compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
