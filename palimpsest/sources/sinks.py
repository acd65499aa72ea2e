"""Sinks: whole files and folders written from restored rows, and an encrypted export of relations."""

from __future__ import annotations

import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ids import scratch


def _placed(folder: str, path: str) -> str:
    """Where a path goes; one that would lead out of the folder is an error."""
    target = os.path.normpath(os.path.join(folder, path.lstrip("/")))
    if os.path.commonpath([folder, target]) != folder:
        raise ValueError(f"{path} leads out of {folder}")
    return target


def _dress(target: str, meta: dict) -> None:
    """Mode and times, and the owner where this user may set it. Links keep their mode."""
    if os.geteuid() == 0 and meta["uid"] is not None and meta["gid"] is not None:
        os.chown(target, meta["uid"], meta["gid"], follow_symlinks=False)
    if meta["mode"] is not None and meta["type"] != "link":
        os.chmod(target, meta["mode"] & 0o7777)
    if meta["mtime"] is not None:
        at = (meta["atime"] or meta["mtime"]).timestamp()
        os.utime(target, (at, meta["mtime"].timestamp()), follow_symlinks=False)


def write_folder(rows: DataFrame, folder: str, only: DataFrame | None = None) -> int:
    """Writes (path, meta, content) below a folder that all executors mount, each task its own rows; returns how many.

    only: (path, action) of a restore plan; rows whose action isn't `write` are left out, and what has the action
    `delete` is removed. A file is replaced in one step. Folders get their mode and times last, deepest first, in one task.
    Writing a row again gives the same file, so a task may run twice.
    """
    folder = os.path.normpath(folder)
    os.makedirs(folder, exist_ok=True)
    if only is not None:
        only = scratch(only, "plan")  # it may have been made from what is in the folder now
        rows = rows.join(only.where("action = 'write'").select("path"), "path", "left_semi")

    def write(batches):
        for batch in batches:
            n = 0
            for r in batch.to_pylist():
                target, meta = _placed(folder, r["path"]), r["meta"]
                os.makedirs(target if meta["type"] == "dir" else os.path.dirname(target), exist_ok=True)
                if meta["type"] == "link":
                    if os.path.lexists(target):
                        os.remove(target)
                    os.symlink(meta["link_target"], target)
                elif meta["type"] == "file" and r["content"] is not None:
                    part = f"{target}.part-{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(r["content"])
                    os.replace(part, target)
                elif meta["type"] != "dir":
                    continue
                if meta["type"] != "dir":
                    _dress(target, meta)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    def dress(batches):
        for batch in batches:
            for r in batch.to_pylist():
                _dress(_placed(folder, r["path"]), r["meta"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    def remove(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = _placed(folder, path)
                if os.path.isdir(target) and not os.path.islink(target):
                    shutil.rmtree(target)
                elif os.path.lexists(target):
                    os.remove(target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    total = lambda df, f: df.mapInArrow(f, "n bigint").agg(F.sum("n")).first()[0] or 0
    if only is not None:
        total(only.where("action = 'delete'").select("path"), remove)
    n = total(rows.select("path", "meta", "content"), write)
    folders = rows.where("meta.type = 'dir'").select("path", "meta").coalesce(1).sortWithinPartitions(F.desc("path"))
    total(folders, dress)
    return n


def _key(df: DataFrame, key: bytes) -> Column:
    """The key as a scalar subquery over a one-row view, so that no plan's text shows it."""
    spark = df.sparkSession
    spark.createDataFrame([(bytearray(key),)], "k binary").createOrReplaceTempView("palimpsest_key")
    return F.expr("(SELECT max(k) FROM palimpsest_key)")


def encrypted(df: DataFrame, key: bytes, column: str = "blob") -> DataFrame:
    """AES-GCM with a fresh nonce for each row; a key of 16, 24 or 32 bytes."""
    return df.withColumn(column, F.call_function("aes_encrypt", F.col(column), _key(df, key), F.lit("GCM")))


def decrypted(df: DataFrame, key: bytes, column: str = "blob") -> DataFrame:
    """The inverse; NULL where a row was made with another key or altered."""
    return df.withColumn(column, F.call_function("try_aes_decrypt", F.col(column), _key(df, key), F.lit("GCM")))


def export_relation(rows: DataFrame, key: bytes) -> DataFrame:
    """Each row as encrypted JSON with the SHA-256 of its clear text."""
    clear = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).cast("binary")
    return encrypted(rows.select(F.sha2(clear, 256).alias("hash"), clear.alias("payload")), key, "payload")


def import_relation(rows: DataFrame, key: bytes, schema: str) -> DataFrame:
    """The inverse; fails on a row that the key doesn't open or whose hash differs."""
    clear = decrypted(rows, key, "payload")
    ok = F.coalesce(F.sha2("payload", 256) == F.col("hash"), F.lit(False))
    checked = clear.select(F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("the export is damaged or the key is another one"))).alias("payload"))
    return checked.select(F.from_json(F.col("payload").cast("string"), schema).alias("r")).select("r.*")
