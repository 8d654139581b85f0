"""What the training-data operators share: table access, scratch tables, doc normalisation."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.sources.scratch import root

#: Largest number of rows, and of bytes as JSON, of a side that may be broadcast; they are measured before the hint is given.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = f"{root(spark)}/refloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def few(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df in as many tasks as at most `rows` rows need, for tables of numbers: many small files cost more than they hold."""
    return df.coalesce(max(1, -(-rows // each)))


def discard(*dfs: DataFrame) -> None:
    """Removes tables written by materialize() that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows and `most` bytes, else df as it is."""
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= most else df


def tidy() -> None:
    """At a task's end a Python worker, which serves other tasks later, gives back the memory that it has freed."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def once(key: str, make):
    """An object that a Python worker makes once and keeps for its later tasks, until another key is asked for."""
    import sys
    import types

    held = sys.modules.setdefault("refloom_worker", types.ModuleType("refloom_worker")).__dict__
    if held.get("key") != key:
        held.pop("made", None)
        held["made"], held["key"] = make(), key
    return held["made"]


def arrow_types(spark: SparkSession, columns: str) -> list:
    """The Arrow types of columns given as DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], columns).schema).types


def slices(batch, column: int, most: int = 1 << 20):
    """Parts of an Arrow batch whose texts have at most `most` bytes together, one row at least: what Python makes of
    them at a time stays small, however long the batch's texts are."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mapped_texts(docs: DataFrame, work, columns: str, text: str = "text", id_col: str = "doc_id", key: str = "doc_id") -> DataFrame:
    """(doc_id long, columns): one row for each row. `work` takes the texts of a batch, null as None, and returns a
    list for each column. Ids, null ones and those beyond 2^53 too, don't pass through Python."""
    types = arrow_types(docs.sparkSession, columns)
    names = [key, *docs.sparkSession.createDataFrame([], columns).columns]

    def fill(batches):
        import pyarrow as pa

        try:
            for b in (part for whole in batches for part in slices(whole, 1)):
                got = work(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=k) for c, k in zip(got, types)]], names=names)
        finally:
            tidy()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(fill, f"{key} long, {columns}")


def train_fold(doc_id: Column) -> Column:
    """True for rows that a model may learn from: crc32 of the id's text, mod 3, is not 1."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


SAMPLE_BYTES = 48 << 20  #: bytes of a training sample, at most


def sampled_rows(df: DataFrame, key: str, rows: int, columns: list[str], among: DataFrame | None = None, most: int = SAMPLE_BYTES) -> list:
    """The rows of at most `rows` keys, chosen by a hash of the key, on the driver: the same ones however
    the table is laid out. Only keys are ordered; their rows are measured, and texts are then read for those
    alone, in that order, that fit into `most` bytes. Repeated keys count once each, so at most twice as many rows
    come back. `among` is a table of the keys that may be chosen. For samples that models are fitted on, and for nothing
    else."""
    keys = df.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    if among is not None:
        keys = keys.join(among.select(F.col(key).alias("k")), "k", "left_semi")
    keys = keys.orderBy(F.xxhash64("k"), "k").limit(rows)
    chosen, spark = [r[0] for r in keys.collect()], keys.sparkSession
    own = lambda ks: df.join(F.broadcast(spark.createDataFrame([(k,) for k in ks], keys.schema)), F.col(key) == F.col("k"), "left_semi")
    texts = [c for c, kind in df.select(*columns).dtypes if kind == "string"]
    size = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long")).alias("size")
    sizes = dict(own(chosen).groupBy(key).agg(size).collect()) if chosen else {}
    fit, total = [], 0
    for k in chosen:
        if total + sizes.get(k, 0) <= most:
            fit.append(k)
            total += sizes.get(k, 0)
    got = own(fit).select(*columns).limit(2 * rows).collect() if fit else []
    return sorted(got, key=lambda r: tuple(str(x) for x in r))


class WordTable:
    """Rows of numbers for word forms, as a Python worker meets them: the first `keep` forms are kept, later
    ones are worked out anew for each call. `rows_of` gives the rows of a list of words."""

    def __init__(self, width: int, rows_of, keep: int):
        import numpy as np

        self.rows_of, self.keep = rows_of, keep
        self.memo: dict[str, int] = {}
        self.kept = np.zeros((keep, width), dtype=np.float32)

    def look(self, words: list[str]):
        import numpy as np

        get = self.memo.get
        at = np.array([get(w, -1) for w in words], dtype=np.int64)
        out = self.kept[at]
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = {w: j for j, w in enumerate(dict.fromkeys(words[i] for i in missing))}
            rows = self.rows_of(list(new))
            out[missing] = rows[[new[words[i]] for i in missing]]
            for w, j in list(new.items())[: self.keep - len(self.memo)]:
                self.kept[len(self.memo)] = rows[j]
                self.memo[w] = len(self.memo)
        return out
