"""Dense ids in a given order without gathering rows: range partitions are numbered, then their rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a session on one machine gets one of its own if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(df: DataFrame, name: str = "scratch") -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, and survives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, order: list[Column | str], name: str = "id", start: int = 1) -> DataFrame:
    """df with a dense BIGINT number in `order`, from start on. Ties get an arbitrary order unless `order` breaks them.

    The rows are range-partitioned once and written, so that their partition numbers stay; the only rows that meet in
    one task are one count per partition.
    """
    parts = scratch(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_row", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + (start - 1)).drop("_part", "_row", "_before")
