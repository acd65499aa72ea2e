"""Purge: drops old revisions and what only they refer to; half-dead containers are packed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ids import numbered, scratch
from palimpsest.operators.packing import MOST, build_containers, next_fit, open_containers
from palimpsest.store import Store

STRATEGIES = {"fast": 1.0, "slow": 0.0}


def orphans(refs: DataFrame, upto: int, key: str = "chunk_id") -> DataFrame:
    """Keys that only revisions <= upto refer to."""
    return refs.where(F.col("revision") <= upto).select(key).distinct().join(refs.where(F.col("revision") > upto).select(key), key, "left_anti")


def keepers(refs: DataFrame, upto: int, key: str = "chunk_id") -> DataFrame:
    """Keys that revisions on both sides of the cut refer to."""
    return refs.where(F.col("revision") <= upto).select(key).distinct().join(refs.where(F.col("revision") > upto).select(key), key, "left_semi")


def container_plan(chunks: DataFrame, dead: DataFrame, threshold: float = 0.0) -> DataFrame:
    """container_id, total, removed, ratio, rank, action for containers that hold dead chunks.

    drop: nothing is left in it; repack: its ratio is above the threshold; keep otherwise. Dead ends are told by counts,
    not by a rounded ratio. rank orders by ratio, then id, both descending.
    """
    marked = chunks.select("chunk_id", "container_id").join(dead.select("chunk_id", F.lit(1).alias("_dead")), "chunk_id", "left")
    counts = marked.groupBy("container_id").agg(F.count("*").alias("total"), F.count("_dead").alias("removed")).where("removed > 0")
    ratio = F.col("removed") / F.col("total")
    action = F.when(F.col("removed") == F.col("total"), "drop").when(ratio > threshold, "repack").otherwise("keep")
    return counts.withColumns({"ratio": ratio, "action": action})


def ranked(plan: DataFrame) -> DataFrame:
    """With rank by ratio and id, both descending: for reports; the purge itself needs no order."""
    return numbered(plan, [F.desc("ratio"), F.desc("container_id")], "rank")


def purge(store: Store, upto: int, strategy: str | float = "slow", most: int = MOST, codec: str = "zlib", buckets: int = 16) -> dict[str, int]:
    """Drops revisions <= upto; the others are numbered from 1. strategy: slow, fast, or the ratio above which to repack.

    Everything is written as a new generation, one job for each relation; the pointer moves last, so a purge that fails changes
    nothing. buckets: independent streams that half-dead containers are packed into.
    """
    threshold = STRATEGIES[strategy] if isinstance(strategy, str) else float(strategy)
    last = store.last_revision()
    if not 0 < upto < last:
        raise ValueError(f"revisions up to {upto} of {last} can't be purged")
    refs = store.read("file_tree").where("list_id IS NOT NULL").select("revision", "list_id").join(store.read("chunk_lists").select("list_id", "chunk_id"), "list_id")
    refs = scratch(refs.select("revision", "chunk_id").distinct(), "refs")
    chunks = store.read("chunks")
    live = refs.where(F.col("revision") > upto).select("chunk_id").distinct()
    dead = chunks.select("chunk_id").join(live, "chunk_id", "left_anti")
    plan = scratch(container_plan(chunks, dead, threshold), "plan")
    generation, shift = store.generation + 1, lambda r: F.greatest(r - upto, F.lit(1))

    repacked = store.read("containers").join(plan.where("action = 'repack'").select("container_id"), "container_id", "left_semi")
    owners = chunks.join(live, "chunk_id", "left_semi").select("chunk_id", "sha1", "size", "container_id", "revision")
    data = open_containers(repacked)
    if not (bad := data.where("error IS NOT NULL").limit(1).collect()) == []:
        raise ValueError(f"container {bad[0]['container_id']}: {bad[0]['error']}")
    streams = repacked.select("container_id", F.when(F.split_part("filter", F.lit(":"), F.lit(2)) == "none", "store").otherwise("comp").alias("stream"))
    moving = owners.join(data.select("container_id", "offset", "sha1", "data"), ["container_id", "sha1"]).join(streams, "container_id").withColumn("bucket", F.pmod(F.xxhash64("container_id"), F.lit(buckets)).cast("int")).withColumnRenamed("offset", "was_at")
    placed = scratch(next_fit(moving, ["container_id", "was_at"], most, ["stream", "bucket"]), "placed")
    key = ["stream", "bucket", "container"]
    built = scratch(build_containers(placed, {"comp": codec, "store": "none"}, most), "built")
    base = store.read("containers").agg(F.max("container_id")).first()[0] or 0
    numbers = scratch(numbered(built.select(*key), key, "new_id", base + 1), "numbers")
    moved = placed.select("chunk_id", *key).join(numbers, key).select("chunk_id", "new_id")

    gone = plan.where("action IN ('drop', 'repack')").select("container_id")
    keep_containers = store.read("containers").join(gone, "container_id", "left_anti").withColumn("revision", shift(F.col("revision")))
    keep_chunks = owners.join(moved, "chunk_id", "left").withColumn("container_id", F.coalesce("new_id", "container_id")).withColumn("revision", shift(F.col("revision")))
    lists = store.read("file_tree").where(F.col("revision") > upto).select("list_id").distinct()
    keep_lists = store.read("chunk_lists").join(lists, "list_id", "left_semi").withColumn("revision", shift(F.col("revision")))
    new_containers = built.join(numbers, key).withColumnRenamed("new_id", "container_id").withColumn("revision", F.lit(1))
    names = keep_containers.columns
    store.append("chunks", keep_chunks, None, generation)
    store.append("chunk_lists", keep_lists, None, generation)
    store.append("containers", keep_containers.select(*names).union(new_containers.select(*names)), None, generation)
    for name in ("file_tree", "revision_stats", "warnings", "revisions"):  # the last one commits
        store.append(name, store.read(name).where(F.col("revision") > upto).withColumn("revision", F.col("revision") - upto), None, generation)
    found = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    store._point(generation)
    return {k: found.get(k, 0) for k in ("drop", "repack", "keep")}
