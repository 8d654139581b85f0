"""Stores as Parquet folders: content-addressed blobs, pointers and metadata, encoded units, the graph cache.

Writes are whole files that appear when a job commits, so a reader sees an old table or a new one; a lost task is run
again. Nothing goes through the driver but single rows of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 4  #: of the stored form


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# content-addressed blobs


def blob_key(blob: Column) -> Column:
    return F.sha2(blob, 256)


def put(blobs: DataFrame, path: str) -> None:
    """blobs (blob binary): each content is stored once, under its key; what is there already isn't written again."""
    new = blobs.select(blob_key(F.col("blob")).alias("key"), "blob").dropDuplicates(["key"])
    if _exists(blobs.sparkSession, path):
        new = new.join(blobs.sparkSession.read.parquet(path).select("key"), "key", "left_anti")
    new.withColumn("shard", F.substring("key", 1, 1)).write.mode("append").partitionBy("shard").parquet(path)


def has(keys: DataFrame, path: str) -> DataFrame:
    """keys (key) -> (key, there). Keys name their shard, so only those folders are read."""
    there = keys.sparkSession.read.parquet(path).select("key", F.lit(True).alias("there"))
    return keys.select("key").join(there, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there"))


def get(keys: DataFrame, path: str) -> DataFrame:
    """keys (key) -> (key, blob, sound): sound tells whether the content still has its key; absent keys are dropped."""
    b = keys.sparkSession.read.parquet(path).select("key", "blob")
    return b.join(keys.select("key").distinct(), "key", "left_semi").withColumn("sound", blob_key(F.col("blob")) == F.col("key"))


def compact(spark: SparkSession, path: str, to: str, files: int = 16) -> DataFrame:
    """The table in few sorted files of its own; readers go on with the old one until they are given the new path."""
    t = spark.read.parquet(path)
    t.repartitionByRange(files, t.columns[0]).sortWithinPartitions(t.columns[0]).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


# metadata and versions


def put_meta(rows: DataFrame, path: str, seq: int) -> None:
    """rows (key, value): appended with the number of the write."""
    rows.select("key", "value").withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(path)


def get_meta(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): what was written last."""
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def open_store(spark: SparkSession, path: str, version: int = VERSION) -> str:
    """'created', 'opened', or 'recreated' where another version wrote it; then the old content is gone."""
    meta, state = f"{path}/meta", "created"
    if _exists(spark, meta):
        old = get_meta(spark, meta).where("key = 'version'").first()
        if old and old["value"] == str(version):
            return "opened"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        state = "recreated"
    put_meta(spark.createDataFrame([("version", str(version))], "key string, value string"), meta, 0)
    return state


def seeded(mine: DataFrame, other: DataFrame, toolchain: Column) -> DataFrame:
    """mine, other (unit, key, toolchain): pointers that a new store takes from another workspace's, if the same toolchain
    wrote them; those it has itself stay."""
    take = other.where(F.col("toolchain") == toolchain).join(mine.select("unit"), "unit", "left_anti")
    return mine.withColumn("seeded", F.lit(False)).unionByName(take.withColumn("seeded", F.lit(True)))


def upsert_pointers(pointers: DataFrame, new: DataFrame) -> DataFrame:
    """pointers, new (unit, key, ...): the new row of a unit replaces the old one; blobs and indexes stay as they are."""
    return pointers.join(new.select("unit"), "unit", "left_anti").unionByName(new)


# units as blobs

SYMBOL = "array<struct<id: bigint, name: string, kind: bigint, file: string, line: bigint, col: bigint>>"


def encode_units(symbols: DataFrame) -> DataFrame:
    """symbols (unit, id, name, kind, file, line, col) -> (unit, n, blob binary): a unit's facts in order of their place."""
    rows = F.array_sort(F.collect_list(F.struct("file", "line", "col", "id", "name", "kind")))
    by = symbols.groupBy("unit").agg(rows.alias("r"))
    return by.select("unit", F.size("r").alias("n"), F.encode(F.to_json(F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["kind"].alias("kind"), x["file"].alias("file"), x["line"].alias("line"), x["col"].alias("col")))), "UTF-8").alias("blob"))


def decode_units(blobs: DataFrame) -> DataFrame:
    """(unit, seq, id, name, kind, file, line, col), seq from 0 in the order of the blob."""
    r = blobs.select("unit", F.posexplode(F.from_json(F.decode("blob", "UTF-8"), SYMBOL)).alias("seq", "r"))
    return r.select("unit", F.col("seq").cast("long").alias("seq"), "r.*")


def decode_names(blobs: DataFrame) -> DataFrame:
    """(unit, id, name, kind): the facts that a name lookup needs; the parser skips the other fields."""
    return blobs.select("unit", F.explode(F.from_json(F.decode("blob", "UTF-8"), "array<struct<id: bigint, name: string, kind: bigint>>")).alias("r")).select("unit", "r.*")


# the graph cache


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, manifest: dict[str, str]) -> None:
    """Nodes and edges as JSON lines beside a manifest: version, patterns, flags, digest of the module files."""
    spark = nodes.sparkSession
    nodes.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/nodes")
    edges.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/edges")
    spark.createDataFrame(sorted({"version": str(VERSION), **manifest}.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_graph(spark: SparkSession, path: str, manifest: dict[str, str], node: str, edge: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of the given schemas, or None where there is no cache or its manifest differs in anything."""
    if not _exists(spark, f"{path}/manifest"):
        return None
    found = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/manifest").collect()}  # a few rows
    if found != {"version": str(VERSION), **manifest}:
        return None
    return spark.read.schema(node).json(f"{path}/nodes"), spark.read.schema(edge).json(f"{path}/edges")
