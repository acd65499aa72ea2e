"""The registered queries of this folder, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import table
from palimpsest.llm.oracles import ORACLES  # noqa: F401


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.fingerprints import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels), threshold=0.3)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.chat import conversation_events, digests, format_chats

    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return digests(format_chats(conversation_events(conversations.unionByName(extra))))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), threshold=0.8, size=5)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_token_output, op4_chat, op5_ngram_join, op6_license_scan, op7_bpe, op8_decontamination, op9_token_counts, op10_html_text)}

