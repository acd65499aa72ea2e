"""Deduplication by content key: reports, first-writer-wins, and what an index doesn't know yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import savings


def first_occurrences(chunks: DataFrame, key: str = "sha1", order: tuple[str, ...] = ("path", "pos")) -> DataFrame:
    """One row per key: that of the least order. A grouped minimum, combined before the shuffle."""
    rest = [c for c in chunks.columns if c != key and c not in order]
    return chunks.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(key, "_first.*")


def unknown(chunks: DataFrame, index: DataFrame, key: str = "sha1") -> DataFrame:
    """Chunks whose key isn't in the index."""
    return chunks.join(index.select(key), key, "left_anti")


def known(chunks: DataFrame, index: DataFrame, key: str = "sha1") -> DataFrame:
    """Chunks with the index's columns, by key."""
    return chunks.join(index, key)


def storage_report(files: DataFrame, by: str, key: str = "sha1", size: str = "size") -> DataFrame:
    """by, files, bytes, unique_files, unique_bytes, saved_pct: what exact deduplication within each group saves."""
    contents = files.groupBy(by, key).agg(F.count("*").alias("n"), F.first(size).cast("bigint").alias("one"))
    out = contents.groupBy(by).agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("one")).alias("bytes"), F.count("*").alias("unique_files"), F.sum("one").alias("unique_bytes"))
    return out.withColumn("saved_pct", savings(F.col("bytes"), F.col("unique_bytes")))


def estimated_distinct(files: DataFrame, by: str, key: str = "sha1", error: float = 0.02) -> DataFrame:
    """Approximate number of distinct contents for each group, in constant memory."""
    return files.groupBy(by).agg(F.approx_count_distinct(key, error).alias("approx_unique"))
