"""Incremental maintenance: keys, revalidation, cut-off, garbage collection, invalidation, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.sources.scratch import discard, materialize

REPAIR, REPAIR_SEEDED = 64, 256
KEEP_HOURS = 48


def joined_key(parts: Column) -> Column:
    """SHA-256 of the sorted, comma-joined parts of a group."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), ","), 256)


def content_keys(files: DataFrame) -> DataFrame:
    """files (unit, file) -> (unit, key)."""
    return files.groupBy("unit").agg(joined_key(F.col("file").cast("string")).alias("key"))


def unit_key(version: int, own: Column, deps: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(version)), own, deps), 256)


def revalidate(current: DataFrame, stored: DataFrame, blobs: DataFrame) -> DataFrame:
    """current (unit, key), stored (unit, key), blobs (key): every current unit with why it is stale, or null."""
    s = stored.select("unit", F.col("key").alias("old"))
    b = blobs.select(F.col("key").alias("old"), F.lit(True).alias("there")).distinct()
    x = current.join(s, "unit", "left").join(b, "old", "left")
    return x.select("unit", F.when(F.col("old").isNull(), "missing").when(F.col("old") != F.col("key"), "key").when(F.col("there").isNull(), "blob").alias("stale"))


def action(stale: Column, seeded: bool = False) -> Column:
    return F.when(stale == 0, "none").when(stale <= (REPAIR_SEEDED if seeded else REPAIR), "repair").otherwise("rebuild")


def dependency_keys(edges: DataFrame, exports: DataFrame) -> DataFrame:
    """edges (src, dst), exports (node, export) -> (node, deps): the sorted "dependency:export hash" of each node, joined."""
    each = edges.select("src", "dst").distinct().join(exports.select(F.col("node").alias("dst"), "export"), "dst")
    return each.groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("dst").cast("string"), "export"))), ",").alias("deps"))


def unit_keys(units: DataFrame, edges: DataFrame, version: int = 4) -> DataFrame:
    """units (node, own, export) -> (node, key): what a unit's result depends on, its own content and the exports of its
    dependencies. A dependency whose export stays leaves the key alone, whatever else changes in it."""
    d = units.select("node", "own").join(dependency_keys(edges, units), "node", "left")
    return d.select("node", unit_key(version, F.col("own"), F.coalesce("deps", F.lit(""))).alias("key"))


def reindex(changed: DataFrame, before: DataFrame, after: DataFrame, edges: DataFrame, levels: DataFrame, version: int = 4) -> DataFrame:
    """changed (node); before and after (node, own, export), the units as they were indexed and as they are, a unit's new
    export being known once it is built; levels (node, level) -> (node, level, key): the units that are built again.

    Level by level a unit that was named, or one of whose dependencies was built with another export, gets its key
    anew; it is built, and its export becomes the new one, only if the key differs from the stored one. So a
    change that leaves a unit's export alone goes no further."""
    order = materialize(levels, "levels")
    deps = materialize(edges.select("src", "dst").distinct(), "edges")
    stored = materialize(unit_keys(before, edges, version).withColumnRenamed("key", "stored"), "stored")
    exports = materialize(before.select("node", "export"), "exports")
    todo = materialize(changed.select("node").distinct().join(order, "node"), "todo")
    built, k = todo.select("node", "level", F.lit("").alias("key")).limit(0), -1
    for _ in range(10_000):
        k = todo.where(F.col("level") > k).agg(F.min("level")).first()[0]
        if k is None:
            return built
        now = todo.where(F.col("level") == k).select("node").distinct()
        folded = dependency_keys(deps.join(now.withColumnRenamed("node", "src"), "src", "left_semi"), exports)
        keys = now.join(after.select("node", "own", F.col("export").alias("new")), "node").join(folded, "node", "left").join(stored, "node", "left")
        keys = keys.withColumn("key", unit_key(version, F.col("own"), F.coalesce("deps", F.lit(""))))
        again = materialize(keys.where(~F.col("key").eqNullSafe(F.col("stored"))).select("node", F.lit(k).cast("long").alias("level"), "key", "new"), "again")
        built = built.unionAll(again.select("node", "level", "key"))
        other = again.join(exports, "node", "left").where(~F.col("new").eqNullSafe(F.col("export"))).select("node", "new")
        exports, old = materialize(exports.join(other, "node", "left_anti").unionAll(other.select("node", F.col("new").alias("export"))), "exports"), exports
        ahead = deps.join(other.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).join(order, "node")
        todo, before_todo = materialize(todo.where(F.col("level") > k).unionAll(ahead.where(F.col("level") > k)).distinct(), "todo"), todo
        discard(old, before_todo)
    raise RuntimeError("no end of the walk")


def failed_upwards(failed: DataFrame, edges: DataFrame) -> DataFrame:
    """failed (node) -> (node, cause): every unit that can't be built because a dependency failed, directly or through
    others, with the least of those causes; a unit never falls back to an older result."""
    from refloom.operators.graph import closure

    c = closure(failed.select(F.col("node").alias("seed")), edges).where("seed != node")
    return c.groupBy("node").agg(F.min("seed").alias("cause"))


def reusable(keys: DataFrame, blobs: DataFrame) -> DataFrame:
    """keys (unit, key), blobs (key) -> units whose result is already stored, under whatever name it was built."""
    return keys.join(blobs.select("key").distinct(), "key", "left_semi")


def own_hashes(stored: DataFrame, stats_equal: DataFrame, hashed: DataFrame) -> DataFrame:
    """The stat short-cut: (unit, own, trusted): the stored content hash where a unit's stats are equal, else the one
    that reading its files gave; stored and hashed (unit, own), stats_equal (unit, same)."""
    trusted = stored.join(stats_equal.where("same").select("unit"), "unit", "left_semi").withColumn("trusted", F.lit(True))
    return trusted.unionByName(hashed.join(trusted.select("unit"), "unit", "left_anti").withColumn("trusted", F.lit(False)))


def aged(blobs: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Collection by age alone: blobs (key, mtime) with `swept`."""
    return blobs.withColumn("swept", F.col("mtime") < now - F.expr(f"INTERVAL {days} DAYS"))


def deferred(roots: DataFrame) -> Column:
    """roots (readable): nothing is collected while one of those who share the store can't be read."""
    return F.coalesce(F.bool_or(~F.col("readable")), F.lit(False))


def batches_of(outcomes: DataFrame, size: int = 50) -> DataFrame:
    """outcomes (seq, ok) -> (batch, n, lost): commits of `size` units each; what is lost is counted, not fatal."""
    b = outcomes.withColumn("batch", F.floor((F.col("seq") - 1) / size))
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("long")).alias("lost"))


def sweep(blobs: DataFrame, marks: DataFrame, now: Column, hours: int = KEEP_HOURS) -> DataFrame:
    """blobs (key, mtime, ...) with `swept`: neither marked nor young."""
    m = marks.select("key", F.lit(True).alias("marked")).distinct()
    old = F.col("mtime") < now - F.expr(f"INTERVAL {hours} HOURS")
    return blobs.join(m, "key", "left").withColumn("swept", F.col("marked").isNull() & old).drop("marked")


def survivors(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """cache (unit, complete, imports), changed (unit): entries that are complete, unchanged and import nothing changed."""
    c = changed.select("unit").distinct()
    hit = cache.select("unit", F.explode("imports").alias("i")).join(c.select(F.col("unit").alias("i")), "i", "left_semi").select("unit")
    return cache.where("complete").join(hit.unionAll(c), "unit", "left_anti")


def budget(cache: DataFrame, by: list[str], limit: int) -> DataFrame:
    """cache (.., entry, last_used, size[, pinned]): most recently used first, kept while the running size is within the
    limit. Pinned entries stay whatever they take, and come first."""
    pins = "pinned" in cache.columns
    order = [F.col("pinned").desc()] if pins else []
    w = Window.partitionBy(*by).orderBy(*order, F.col("last_used").desc(), "entry").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("running") <= limit
    return cache.withColumn("running", F.sum("size").over(w)).withColumn("kept", F.col("pinned") | fits if pins else fits)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new (unit, file) -> (unit, change): added, removed or changed units."""
    pack = lambda d, n: d.groupBy("unit").agg(F.sort_array(F.collect_set("file")).alias(n))
    x = pack(old, "a").join(pack(new, "b"), "unit", "full")
    return x.select("unit", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change IS NOT NULL")
