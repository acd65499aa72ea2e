"""Connected components by alternating stars: every step is a grouped minimum and a join, so no group is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

SALTS = 64


def hot_join(left: DataFrame, right: DataFrame, key: str, *by) -> DataFrame:
    """Left join on a key that most rows of left may share: left is dealt by key and a hash of `by`.

    right goes to all SALTS places of its key, so it should have few rows.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"], "left").drop("_salt")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node in edges (a, b), of any type that has an order: root is the component's least node.

    No edges: no rows. Edges lead from a greater node a to a lesser one b. First all that lead to a node lead to its least
    neighbour instead; only nodes that have greater and lesser neighbours matter there, and a star has none of them, so its
    centre needs no join however many edges it has. Then the lesser neighbours of each node are tied to the least of them.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        between = least.join(now.select("b").distinct(), "b", "left_semi")
        large = hot_join(now, between, "b", "a").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        now, before = written(small.distinct(), "edges"), mark
        if (mark := _mark(now)) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
    raise RuntimeError(f"no stable components after {most_rounds} rounds")
