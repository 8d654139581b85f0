"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import table, train_fold
from refloom.llm.decontam import ORACLE as DECONTAMINATION_SQL

SURROGATE_KEY = "key of the registered query, over synthetic data; other callers pass a secret of their own"


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.secrets import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.langid import identify

    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.chunkdedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.toxicity import toxicity

    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector packing of op9 over whole conversations: loss on what the assistant says, at most half a sequence of it."""
    from refloom.llm.packing import Limits, pack_conversations

    return pack_conversations(table(spark, sf_dir, "conversations"), Limits(1024, 8, 512))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.llm.surrogates import replace_entities

    return replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


QUERIES = {f.__name__: f for f in (op1_ogg_media, op2_decontamination, op3_secret_scan, op4_near_duplicates, op5_language_id, op6_token_counts, op7_chunk_dedup, op8_toxicity, op9_vector_packing, instruction_packing, op10_surrogates)}

ORACLE_SQL: dict[str, str] = {"op2_decontamination": DECONTAMINATION_SQL}
