"""Scratch tables in the cluster's shared folder; they cut the lineage of loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local folder serves a local master, whose executors see
    it; on a cluster they wouldn't, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
    global _local
    if _local is None:
        import atexit
        import shutil
        import tempfile

        _local = tempfile.mkdtemp(prefix="refloom-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


_local: str | None = None


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    spark = df.sparkSession
    path = f"{root(spark)}/refloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Removes tables written by materialize() that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
