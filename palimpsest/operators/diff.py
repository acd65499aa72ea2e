"""What differs between two trees: added, deleted, modified and unchanged paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import meta


def tree_diff(before: DataFrame, after: DataFrame, same: Column | None = None, key: str = "path") -> DataFrame:
    """key, status, and both sides' other columns as structs `was` and `is`. One full outer join on the key.

    same: a predicate over was and is; by default all columns are equal, NULLs included.
    """
    pack = lambda df, name: df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))
    both = pack(before, "was").join(pack(after, "is"), key, "full_outer")
    same = F.col("was").eqNullSafe(F.col("is")) if same is None else same
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return both.select(key, status.alias("status"), "was", "is")


def changed_files(current: DataFrame, previous: DataFrame, mask: str = "all_but_access_time") -> DataFrame:
    """current with is_changed and the list_id of unchanged files. Both have path and meta, previous also list_id."""
    old = previous.select("path", F.col("meta").alias("_was"), F.col("list_id").alias("_list_id"))
    joined = current.join(old, "path", "left")
    unchanged = meta.similar(F.col("meta"), F.col("_was"), mask)
    return joined.withColumn("is_changed", ~unchanged).withColumn("list_id", F.when(unchanged, F.col("_list_id"))).drop("_was", "_list_id")


def deleted_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("path"), "path", "left_anti")


def worth_saving(diff: DataFrame) -> bool:
    """Whether anything changed; stops at the first such row."""
    return not diff.where(F.col("status") != "unchanged").select("status").limit(1).isEmpty()


def restore_plan(wanted: DataFrame, present: DataFrame, overwrite: str = "update", delete_extra: bool = False) -> DataFrame:
    """path and action (write, skip, warn, delete, keep) for restoring over what is there. overwrite: no, update or yes.

    Both have path and meta. `update` leaves a file that is newer where it is.
    """
    if overwrite not in ("no", "update", "yes"):
        raise ValueError(overwrite)
    both = wanted.select("path", F.col("meta").alias("new")).join(present.select("path", F.col("meta").alias("old")), "path", "full_outer")
    differs = {"no": F.lit("warn"), "update": F.when(F.col("old.mtime") > F.col("new.mtime"), "skip").otherwise("write"), "yes": F.lit("write")}[overwrite]
    action = F.when(F.col("new").isNull(), "delete" if delete_extra else "keep").when(F.col("old").isNull(), "write").when(meta.similar(F.col("new"), F.col("old"), "all"), "skip").otherwise(differs)
    return both.select("path", action.alias("action"))
