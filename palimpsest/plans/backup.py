"""Backup: one revision from a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import paths
from palimpsest.operators.chunking import chunk_rows
from palimpsest.operators.dedup import first_occurrences, unknown
from palimpsest.operators.diff import changed_files
from palimpsest.operators.ids import numbered, scratch
from palimpsest.operators.packing import MOST, build_containers, next_fit, route
from palimpsest.operators.rules import Rule, kept
from palimpsest.store import Store

META = ["type", "size", "mode", "uid", "gid", "ctime", "mtime", "atime", "link_target"]
REGULAR = ("file", "dir", "link", "char", "block")


def with_parents(files: DataFrame) -> DataFrame:
    """files and a bare directory row for each parent that isn't among them (its own row may have been excluded)."""
    wanted = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct().join(files.select("path"), "path", "left_anti")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("path", "name", "type", "size") else {"path": F.col("path"), "name": paths.name(F.col("path")).alias("name"), "type": F.lit("dir").alias("type"), "size": F.lit(0).cast("bigint").alias("size")}[f.name] for f in files.schema.fields]
    return files.unionByName(wanted.select(*blank))


def backup(store: Store, files: DataFrame, exclude: list[Rule] = (), include: list[Rule] = (), codec: str = "zlib", threshold: float = 1.0, most: int = MOST, buckets: int = 16, created_at=None, chunker: str = "TTTD", **options) -> int | None:
    """Adds a revision and returns its number, or None if nothing differs from the last one.

    files: rows of palimpsest.schemas.FILES, unique by path. threshold: chunks of a higher entropy are stored uncompressed.
    buckets: independent packing streams, by path; more of them pack in parallel, into other containers. What is packed where
    is told from sizes alone; bytes move to the task that chunks their file, to their chunk's number, and to their container.
    """
    revision = store.last_revision() + 1
    warnings = files.where(~F.col("type").isin(*REGULAR)).select(F.lit("skip").alias("action"), "path", F.concat(F.lit("not a regular file: "), "type").alias("message"))
    rows = with_parents(kept(files.where(F.col("type").isin(*REGULAR)), list(exclude), list(include)))
    rows = rows.withColumn("meta", F.struct(*META))
    previous = store.tree(revision - 1).select("path", "meta", "list_id")
    # content stays out of the shuffles for the tree: paths are joined first
    tree = scratch(changed_files(rows.select("path", "name", "meta"), previous), "tree")
    gone = previous.join(tree, "path", "left_anti")
    if revision > 1 and tree.where("is_changed").isEmpty() and gone.isEmpty():
        return None

    changed = tree.where("is_changed AND meta.type = 'file'").select("path")
    contents = rows.where("type = 'file'").select("path", "content").join(changed, "path", "left_semi")
    chunks = scratch(chunk_rows(contents, chunker=chunker, with_entropy=threshold < 1, **options), "chunks")
    rest = ["size", *["entropy"] * (threshold < 1)]
    new = unknown(first_occurrences(chunks.select("sha1", "path", "pos", *rest)), store.read("chunks"))
    last = store.read("chunks").agg(F.max("chunk_id")).first()[0] or 0
    new = scratch(numbered(new, ["path", "pos"], "chunk_id", last + 1), "new")

    stream = route(F.col("entropy"), threshold) if threshold < 1 else F.lit("comp")
    placed = next_fit(new.withColumns({"stream": stream, "bucket": F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")}), ["path", "pos"], most, ["stream", "bucket"])
    placed = scratch(placed, "placed")
    base = store.read("containers").agg(F.max("container_id")).first()[0] or 0
    data = chunks.select("path", "pos", "data").join(placed.select("path", "pos", "sha1", "stream", "bucket", "container", "offset"), ["path", "pos"])
    built = scratch(build_containers(data, {"comp": codec, "store": "none"}, most), "built")
    key = ["stream", "bucket", "container"]
    numbers = scratch(numbered(built.select(*key), key, "container_id", base + 1), "numbers")
    store.append("containers", built.join(numbers, key), revision)
    stored = placed.join(numbers, key)
    store.append("chunks", stored.select("chunk_id", "sha1", "size", "container_id"), revision)

    index = store._all("chunks").where((F.col("revision") == revision) | F.col("revision").isin([r[0] for r in store.revisions().select("revision").collect()])).select("sha1", "chunk_id")
    lists = store.read("chunk_lists").agg(F.max("list_id")).first()[0] or 0
    numbered_files = scratch(numbered(tree.where("is_changed AND meta.type = 'file'").select("path"), ["path"], "new_list", lists + 1), "lists")
    store.append("chunk_lists", chunks.join(index, "sha1").join(numbered_files, "path").select(F.col("new_list").alias("list_id"), "pos", "chunk_id", "offset"), revision)

    items = numbered(tree.join(numbered_files, "path", "left"), ["path"], "item_id")
    items = scratch(items.select("item_id", "path", "name", "meta", F.coalesce("new_list", "list_id").alias("list_id"), "is_changed"), "items")
    parents = items.select(F.col("path").alias("_parent"), F.col("item_id").alias("parent_id"))
    store.append("file_tree", items.join(parents, paths.parent(F.col("path")) == F.col("_parent"), "left"), revision)

    file = (F.col("meta.type") == "file") & F.col("is_changed")
    stats = items.agg(F.count_if(file).alias("file_count"), F.count_if(F.col("meta.type") == "dir").alias("dir_count"), F.coalesce(F.sum(F.when(file, F.col("meta.size"))), F.lit(0)).alias("ingested_bytes"), F.coalesce(F.sum(F.when(F.col("meta.type") == "file", F.col("meta.size"))), F.lit(0)).alias("total_bytes"))
    size = built.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).cast("bigint").alias("stored_bytes"))
    store.append("revision_stats", stats.join(size), revision)  # two rows of totals
    store.append("warnings", warnings, revision)
    store.commit(revision, created_at)
    return revision
