"""Reading back: whole revisions, single files, byte ranges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.packing import open_containers
from palimpsest.store import Store


def chunk_refs(store: Store, files: DataFrame) -> DataFrame:
    """path, pos, file_offset, size, sha1, container_id of every chunk of (path, list_id); missing ones have NULLs."""
    lists, chunks = store.read("chunk_lists"), store.read("chunks")
    refs = files.where("list_id IS NOT NULL").select("path", "list_id").join(lists.select("list_id", "pos", "chunk_id", F.col("offset").alias("file_offset")), "list_id")
    return refs.join(chunks.select("chunk_id", "sha1", "size", "container_id"), "chunk_id", "left").select("path", "pos", "file_offset", "size", "sha1", "container_id", "chunk_id")


def chunk_data(store: Store, refs: DataFrame) -> DataFrame:
    """refs with data and error. Only containers that are needed are decoded, each once; chunks then go to their files."""
    needed = refs.select("container_id").distinct()
    opened = open_containers(store.read("containers").join(needed, "container_id", "left_semi"))
    good = opened.where("error IS NULL").select("container_id", "sha1", "data").dropDuplicates(["container_id", "sha1"])
    bad = opened.where("error IS NOT NULL").select("container_id", "error")
    out = refs.join(good, ["container_id", "sha1"], "left").join(bad, "container_id", "left")
    missing = F.when(F.col("data").isNull(), F.coalesce("error", F.when(F.col("container_id").isNull(), F.concat(F.lit("no chunk "), "chunk_id")).otherwise(F.concat(F.lit("no chunk in container "), "container_id"))))
    return out.withColumn("error", missing)


def assemble(parts: DataFrame) -> DataFrame:
    """path, content, error from (path, pos, data, error): a file's parts are streamed in order; a file with an error has no content."""

    def run(batches):
        now, own, wrong = None, [], None
        for batch in batches:
            for path, _, data, error in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is not None and path != now:
                    yield row(now, own, wrong)
                    own, wrong = [], None
                now = path
                own.append(data)
                wrong = wrong or error
        if now is not None:
            yield row(now, own, wrong)

    row = lambda path, own, wrong: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None if wrong else b"".join(own)], pa.binary()), pa.array([wrong], pa.string())], names=["path", "content", "error"])
    return parts.select("path", "pos", "data", "error").repartition("path").sortWithinPartitions("path", "pos").mapInArrow(run, "path string, content binary, error string")


def restore(store: Store, revision: int) -> DataFrame:
    """path, meta, content, error of all items, in no order. Empty files have empty content; other items none."""
    tree = store.tree(revision)
    made = assemble(chunk_data(store, chunk_refs(store, tree)))
    out = tree.select("path", "meta").join(made, "path", "left")
    content = F.when((F.col("meta.type") == "file") & F.col("error").isNull(), F.coalesce("content", F.unhex(F.lit(""))))
    return out.select("path", "meta", content.alias("content"), "error")


def _file(store: Store, path: str, revision: int) -> DataFrame:
    return store.tree(revision).where((F.col("path") == path) & (F.col("meta.type") == "file"))


def _whole(item: DataFrame, made: DataFrame) -> DataFrame:
    """A row for each item: content is empty where nothing was made, and NULL beside an error."""
    return item.select("path").join(made, "path", "left").select("path", F.when(F.col("error").isNull(), F.coalesce("content", F.unhex(F.lit("")))).alias("content"), "error")


def cat(store: Store, path: str, revision: int) -> DataFrame:
    """content of one regular file; no row where there is no such file."""
    item = _file(store, path, revision)
    return _whole(item, assemble(chunk_data(store, chunk_refs(store, item))))


def overlapping(refs: DataFrame, start: int, length: int, group: str | list[str] = "path", order: str = "pos") -> DataFrame:
    """Rows with size whose bytes lie in [start, start + length), with skip and take: the part of each that is wanted."""
    group = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = refs.withColumn("file_offset", F.coalesce(F.sum(F.col("size").cast("bigint")).over(w), F.lit(0).cast("bigint")))
    rows = rows.where((F.col("file_offset") < start + length) & (F.col("file_offset") + F.col("size") > start))
    skip = F.greatest(F.lit(start) - F.col("file_offset"), F.lit(0))
    take = F.least(F.col("size") - skip, F.lit(start + length) - F.col("file_offset") - skip)
    return rows.withColumns({"skip": skip, "take": take})


def read_range(store: Store, path: str, revision: int, start: int, length: int) -> DataFrame:
    """content of a byte range of one regular file, as much of it as the file has; no row where there is no such file.

    Chunks outside of the range are not fetched.
    """
    item = _file(store, path, revision)
    wanted = overlapping(chunk_refs(store, item), start, length)
    parts = chunk_data(store, wanted).withColumn("data", F.substring(F.col("data"), (F.col("skip") + 1).cast("int"), F.col("take").cast("int")))
    return _whole(item, assemble(parts))
