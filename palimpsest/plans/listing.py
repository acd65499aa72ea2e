"""Listing: revisions, files of one, folders, whole dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import meta, paths
from palimpsest.functions.text import savings
from palimpsest.operators.ids import scratch
from palimpsest.store import Store


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows from start to end, both included; one alone is a bound alone."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("timestamp"))


def list_revisions(store: Store, start=None, end=None) -> DataFrame:
    """Newest first, with the totals and the percentage saved (NULL where nothing was counted)."""
    rows = in_range(store.revisions(), "created_at", start, end).join(store.read("revision_stats"), "revision", "left")
    return rows.withColumn("saved_pct", savings(F.col("ingested_bytes"), F.col("stored_bytes"))).orderBy(F.desc("revision"))


def list_files(store: Store, revision: int) -> DataFrame:
    """One line per path, in order of path; of rows with one path the last counts."""
    rows = store.tree(revision).groupBy("path").agg(F.max(F.struct("item_id", "meta")).alias("x")).select("path", "x.*")
    return rows.select("path", "item_id", meta.pretty(F.col("meta")).alias("line")).orderBy("path")


def list_dir(store: Store, revision: int, path: str) -> DataFrame:
    return store.tree(revision).where(paths.parent(F.col("path")) == path.rstrip("/")).orderBy("name")


def list_dirs(store: Store, revision: int) -> DataFrame:
    """Folders, each behind its parent."""
    return store.tree(revision).where("meta.type = 'dir'").orderBy("path")


def lookup(store: Store, revision: int, path: str) -> DataFrame:
    """The item at a path, the last one if there are several."""
    rows = store.tree(revision).where(F.col("path") == path)
    return rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "item_id").alias("x")).select("x.*")


def full_paths(items: DataFrame, most_depth: int = 1000) -> DataFrame:
    """id, path, depth of (id, parent, name): roots have no parent. One join for each level; items below no root are left out."""
    level = scratch(items.where("parent IS NULL").select("id", F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth")), "level")
    below = items.where("parent IS NOT NULL").select(F.col("id").alias("_id"), "parent", "name")
    out = level
    for _ in range(most_depth):
        level = scratch(level.join(below, F.col("id") == F.col("parent")).select(F.col("_id").alias("id"), F.concat_ws("/", "path", "name").alias("path"), (F.col("depth") + 1).alias("depth")), "level")
        if level.isEmpty():
            return out
        out = out.union(level)
    raise RuntimeError(f"folders nested more than {most_depth} deep")


def stat(store: Store, path: str) -> DataFrame:
    """The item at /revision/path as a read-only file system shows it: name, type, mode, size, mtime; folders have mode 0555.

    The root and each revision are folders; no row where there is nothing.
    """
    first, _, rest = path.strip("/").partition("/")
    folder = [F.lit("dir").alias("type"), F.lit(0o040555).alias("mode"), F.lit(0).cast("bigint").alias("size")]
    if not first:
        return store.spark.range(1).select(F.lit("/").alias("name"), *folder, F.lit(None).cast("timestamp").alias("mtime"))
    if not first.isdigit():
        return stat(store, "/").limit(0)
    if not rest:
        return store.revisions().where(F.col("revision") == int(first)).select(F.lit(first).alias("name"), *folder, F.col("created_at").alias("mtime"))
    m = F.col("meta")
    mode = F.when(m["type"] == "dir", F.lit(0o040555)).otherwise(m["mode"].bitwiseAND(~0o222))
    return lookup(store, int(first), f"/{rest}").select("name", m["type"].alias("type"), mode.alias("mode"), m["size"].alias("size"), m["mtime"].alias("mtime"))


def read_dir(store: Store, path: str) -> DataFrame:
    """Names below /revision/path, in order; the root holds the revisions."""
    first, _, rest = path.strip("/").partition("/")
    if not first:
        return store.revisions().select(F.col("revision").cast("string").alias("name")).orderBy(F.col("name").cast("int"))
    return list_dir(store, int(first), f"/{rest}" if rest else "").select("name")


def read_link(store: Store, path: str) -> DataFrame:
    """target of the link at /revision/path; no row where there is none."""
    first, _, rest = path.strip("/").partition("/")
    return lookup(store, int(first), f"/{rest}").where("meta.type = 'link'").select(F.col("meta.link_target").alias("target"))


def file_system_size(store: Store, block: int = 512) -> DataFrame:
    """blocks that the files of the last revision take, as statfs tells them."""
    last = store.read("revision_stats").agg(F.max_by("total_bytes", "revision").alias("n"))
    return last.select(F.call_function("div", F.col("n"), F.lit(block)).alias("blocks"))


def dump(store: Store, revision: int) -> dict[str, DataFrame]:
    from palimpsest.schemas import RELATIONS

    return {name: store.read(name).where(F.col("revision") == revision) for name in RELATIONS}


def resolve_links(tree: DataFrame, most_hops: int = 30) -> DataFrame:
    """path, target, hops of each link; a target that is still a link after most_hops is NULL.

    A relative link is taken from its own folder. Each hop is one join of the links that still lead to links.
    """
    links = tree.where("meta.type = 'link'")
    target = F.when(F.startswith("meta.link_target", F.lit("/")), F.col("meta.link_target")).otherwise(F.concat(paths.parent(F.col("path")), F.lit("/"), F.col("meta.link_target")))
    step = links.select("path", paths.normalized(target).alias("next"))
    now = step.select("path", F.col("next").alias("target"), F.lit(1).alias("hops"))
    done = None
    for _ in range(most_hops):
        hop = now.join(step.select(F.col("path").alias("target"), F.col("next").alias("further")), "target", "left")
        ended = hop.where("further IS NULL").select("path", "target", "hops")
        done = ended if done is None else done.unionByName(ended)
        now = hop.where("further IS NOT NULL").select("path", F.col("further").alias("target"), (F.col("hops") + 1).alias("hops"))
        now = scratch(now, "links")
        if now.isEmpty():
            return done
    return done.unionByName(now.select("path", F.lit(None).cast("string").alias("target"), "hops"))


def escaping_links(tree: DataFrame, root: str) -> DataFrame:
    """Warnings for links that lead out of the root."""
    out = resolve_links(tree).where(~F.startswith("target", F.lit(root)) | F.col("target").isNull())
    return out.select(F.lit("link").alias("action"), "path", F.lit("leads out of the root").alias("message"))
