"""Corpus pipeline: quality, near duplicates, benchmark decontamination, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that the one before it kept; the first three return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.bpe import encode_decode
from palimpsest.llm.common import table, written
from palimpsest.llm.decontaminate import without_leaks
from palimpsest.llm.ngram_join import one_of_each
from palimpsest.llm.quality import accepted, fit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is an empty one; null keys, ties and repeated rows are judged by their text; without labels of both kinds
    none goes that the prior accepts; an empty table stays empty; extra columns stay.
    """
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least key, one of a null key only for want of others.

    Null and empty texts are copies of each other; repeated rows are one; rows of one key with different texts are documents
    of their own; an empty table stays empty; extra columns stay.
    """
    return one_of_each(docs, threshold=0.8, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and items without words are in none; null keys and repeated rows are judged by their text;
    an empty benchmark takes nothing away, an empty table stays empty; extra columns stay.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded: a row for each row, null texts as empty ones, without extra columns."""
    return encode_decode(docs, "word_bpe_49k.json")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: A compression classifier can't be put into SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
