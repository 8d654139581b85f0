"""File sources and sinks: texts with overlays, stats, partitioned tables with exact replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, size, mtime) of the files below a folder; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def texts(spark: SparkSession, folder: str, overlay: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(path, text): the newest overlay version of a path (uri, version, text) before what is stored."""
    disk = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", F.col("content").cast("string").alias("stored"))
    if overlay is None:
        return disk.withColumnRenamed("stored", "text")
    return disk.join(current(overlay).withColumnRenamed("uri", "path"), "path", "full").select("path", F.coalesce("text", "stored").alias("text"))


def current(overlay: DataFrame) -> DataFrame:
    """(uri, text) of the newest version of each document."""
    return overlay.groupBy("uri").agg(F.max_by("text", "version").alias("text"))


def same_stats(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(unit, same): as many files, each with equal size and time. Both sides: (unit, path, size, mtime)."""
    x = stored.select("unit", "path", F.col("size").alias("s0"), F.col("mtime").alias("m0")).join(now.select("unit", "path", "size", "mtime"), ["unit", "path"], "full")
    equal = F.coalesce((F.col("s0") == F.col("size")) & (F.col("m0") == F.col("mtime")), F.lit(False))
    return x.groupBy("unit").agg(F.bool_and(equal).alias("same"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys new doesn't have, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
