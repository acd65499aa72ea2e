"""Files of a folder tree as rows.

`read_files` is Spark's distributed binary reader. The `filetree` data source also has what only lstat knows (links,
owners, modes), for trees that every executor mounts; folders are opened until there are enough
entries to deal out over `partitions` (64) tasks.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions import paths
from palimpsest.schemas import FILES

KINDS = ((stat.S_ISLNK, "link"), (stat.S_ISDIR, "dir"), (stat.S_ISREG, "file"), (stat.S_ISCHR, "char"), (stat.S_ISBLK, "block"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size, mtime, content of all files below; content is only read where it is used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", paths.name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


class _Part(InputPartition):
    """Entries below the root: `deep` ones with all that they hold, `bare` ones by themselves."""

    def __init__(self, deep: list[str], bare: list[str]):
        self.deep, self.bare = deep, bare


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.parts = int(options.get("partitions", "64"))

    def _below(self, relative: str) -> list[str]:
        names = sorted(os.listdir(os.path.join(self.root, relative)))
        return [f"{relative}/{n}" if relative else n for n in names if self.hidden or not n.startswith(".")]

    def _is_folder(self, relative: str) -> bool:
        full = os.path.join(self.root, relative)
        return os.path.isdir(full) and not os.path.islink(full)

    def partitions(self):
        """Folders are opened, breadth first, until there are enough entries to deal out."""
        opened, files, folders = [], [], deque([""])
        while folders and len(files) + len(folders) < 4 * self.parts:
            opened.append(x := folders.popleft())
            for y in self._below(x):
                (folders if self._is_folder(y) else files).append(y)
        opened = opened[1:]  # without the root
        parts = [_Part(list(folders)[i :: self.parts], (opened + files)[i :: self.parts]) for i in range(self.parts)]
        return [p for p in parts if p.deep or p.bare] or [_Part([], [])]

    def read(self, partition):
        """Breadth first; links are rows and aren't followed."""
        for relative in partition.bare:
            yield self._row(relative)
        queue = deque(partition.deep)
        while queue:
            relative = queue.popleft()
            if self._is_folder(relative):
                queue += self._below(relative)
            yield self._row(relative)

    def _row(self, relative: str) -> tuple:
        full = os.path.join(self.root, relative)
        s = os.lstat(full)
        kind = next((k for test, k in KINDS if test(s.st_mode)), "unknown")
        data = None
        if kind == "file" and self.content:
            with open(full, "rb") as f:
                data = f.read()
        t = lambda x: datetime.fromtimestamp(x, timezone.utc)
        return ("/" + relative, os.path.basename(relative), kind, s.st_size if kind == "file" else 0, s.st_mode, s.st_uid, s.st_gid, t(s.st_ctime), t(s.st_mtime), t(s.st_atime), os.readlink(full) if kind == "link" else None, data)


class FileTree(DataSource):
    """spark.read.format("filetree").option("hidden", False).load(folder), after spark.dataSource.register(FileTree)."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return FILES

    def reader(self, schema):
        return _TreeReader(self.options)


def document_files(docs: DataFrame) -> DataFrame:
    """A table of documents as files: /source/doc_id with the text's bytes."""
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    null = lambda kind: F.lit(None).cast(kind)
    t = F.timestamp_seconds(F.lit(0))
    return docs.select(path.alias("path"), F.col("doc_id").cast("string").alias("name"), F.lit("file").alias("type"), F.octet_length(content).cast("bigint").alias("size"), F.lit(0o100644).alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), t.alias("ctime"), t.alias("mtime"), t.alias("atime"), null("string").alias("link_target"), content.alias("content"))
