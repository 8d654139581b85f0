"""Change streams: debounce, duplicate suppression, newest-generation gate, routing.

Each operator has a batch form over a table of events and a form over a stream. Debounce is by event time
here: sessions of events closer than a gap. The batch form defines the result; a stream that ends (for
instance trigger `availableNow`) gives the same rows once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap_seconds: int, keys: list[str]) -> DataFrame:
    """Batch: (keys, first, last, n, reload): runs of events less than the gap apart."""
    w = Window.partitionBy(*keys).orderBy("mtime", "gen")
    new = F.coalesce((F.unix_micros(F.col("mtime").cast("timestamp")) - F.lag(F.unix_micros(F.col("mtime").cast("timestamp"))).over(w)) >= gap_seconds * 1_000_000, F.lit(True))
    run = events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return run.groupBy(*keys, "session").agg(F.min("mtime").alias("first"), F.max("mtime").alias("last"), F.count("*").alias("n"), F.bool_or("is_module").alias("reload"))


def stream_sessions(events: DataFrame, gap_seconds: int, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """The stream's form: session windows behind a watermark."""
    e = events.withColumn("ts", F.col("mtime").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("w"), *keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.max(F.col("is_module").cast("int")).alias("reload"))


def changed_only(events: DataFrame) -> DataFrame:
    """Events that differ from the last one of the path. An event goes only if its size and time equal the last ones
    and both were hashed (`hash` isn't null) and the hashes are equal; a deletion is kept and forgets."""
    w = Window.partitionBy("path").orderBy("mtime", "gen")
    last = lambda c: F.lag(c).over(w)
    same = (last("size") == F.col("size")) & (last("mtime") == F.col("mtime")) & (last("hash") == F.col("hash")) & ~last("is_delete")
    return events.withColumn("_same", F.coalesce(same, F.lit(False))).where(F.col("is_delete") | ~F.col("_same")).drop("_same")


def stream_changed_only(events: DataFrame) -> DataFrame:
    """The stream's form, in order of arrival: (path, gen) of the events that stay; the state of a path is its last
    size, time and hash, and a deletion drops it."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def gate(k, batches, state: GroupState):
        last, out = state.get if state.exists else None, []
        for b in batches:
            for g, size, at, h, gone in zip(b["gen"].tolist(), b["size"].tolist(), b["at"].tolist(), b["hash"], b["is_delete"].tolist()):
                now = (int(size), int(at), None if h is None or h != h else str(h))
                if gone:
                    last = None
                    out.append(g)
                elif last is None or now[2] is None or tuple(last) != now:
                    last = now
                    out.append(g)
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(last))
        yield pd.DataFrame({"path": [k[0]] * len(out), "gen": out})

    e = events.select("path", "gen", "size", F.unix_micros(F.col("mtime").cast("timestamp")).alias("at"), F.col("hash").cast("string").alias("hash"), "is_delete")
    return e.groupBy("path").applyInPandasWithState(gate, "path long, gen long", "size long, at long, hash string", "append", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame, key: str = "path") -> DataFrame:
    """The row of the newest generation of each key."""
    rest = [c for c in events.columns if c not in (key, "gen")]
    return events.groupBy(key).agg(F.max(F.struct("gen", *rest)).alias("r")).select(key, "r.*")


def commit_newest(events: DataFrame, key: str = "path") -> DataFrame:
    """The stream's form of the gate: keeps the newest generation of a key as state and emits a row only if
    its generation is at least that."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def gate(k, batches, state: GroupState):
        newest = state.get[0] if state.exists else None
        for b in batches:
            out = []
            for g in b["gen"].tolist():  # in order of arrival
                if newest is None or g >= newest:
                    newest = g
                    out.append(g)
            yield pd.DataFrame({key: [k[0]] * len(out), "gen": out})
        if newest is not None:
            state.update((int(newest),))

    return events.groupBy(key).applyInPandasWithState(gate, f"{key} long, gen long", "gen long", "append", GroupStateTimeout.NoTimeout)


def route(is_delete: Column, is_module: Column, known: Column) -> Column:
    """What an event asks for: a module file or a deleted or unknown file reloads the graph, a known one is
    marked dirty."""
    return F.when(is_module, "reload").when(is_delete | ~known, "graph").otherwise("dirty")


def drain(events: DataFrame) -> DataFrame:
    """What a drain of the dirty set takes: the paths of a batch of events that mark, once each."""
    return events.where("NOT is_module AND NOT is_delete").select("path").distinct()


def in_order(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """Every event with its turn in the queue of its key, and how many of the key came before it (what a request waits
    for)."""
    w = Window.partitionBy(key).orderBy(sequence)
    return events.withColumn("turn", F.row_number().over(w)).withColumn("waits_for", F.col("turn") - 1)


def pending_opens(events: DataFrame, ready: Column) -> DataFrame:
    """events (uri, gen, kind) -> documents that are open when the workspace gets ready: opened before and not closed
    again; what comes later isn't pending."""
    early = events.where(F.col("gen") < ready).where("kind IN ('open', 'close')")
    last = early.groupBy("uri").agg(F.max_by("kind", "gen").alias("kind"), F.max("gen").alias("gen"))
    return last.where("kind = 'open'").select("uri", "gen")


def document_state(events: DataFrame) -> DataFrame:
    """events (uri, gen, kind, text): open and change set the text, close forgets it, save asks for a new index ->
    (uri, gen, kind, text, version, reindex) after each event; text is null while the document is closed."""
    w = Window.partitionBy("uri").orderBy("gen")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    life = events.withColumn("_life", F.sum(F.when(F.col("kind").isin("open", "close"), 1).otherwise(0)).over(upto))
    inside = Window.partitionBy("uri", "_life").orderBy("gen").rowsBetween(Window.unboundedPreceding, 0)
    text = F.last(F.when(F.col("kind").isin("open", "change"), F.col("text")), ignorenulls=True).over(inside)
    opened = F.max((F.col("kind") == "open").cast("int")).over(inside) == 1
    version = F.sum(F.when(F.col("kind").isin("open", "change"), 1).otherwise(0)).over(inside)
    out = life.select("uri", "gen", "kind", F.when(opened, text).alias("text"), F.when(opened, version).alias("version"), (opened & (F.col("kind") == "save")).alias("reindex"))
    return out


def stream_documents(events: DataFrame) -> DataFrame:
    """The stream's form, in order of arrival: the state of a document is its text and version while it is open."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def follow(k, batches, state: GroupState):
        text, version = state.get if state.exists else (None, None)
        rows = []
        for b in batches:
            for g, kind, new in zip(b["gen"].tolist(), b["kind"], b["text"]):
                if kind == "open":
                    text, version = new, 1
                elif kind == "change" and version is not None:
                    text, version = new, version + 1
                elif kind == "close":
                    text = version = None
                rows.append((k[0], g, kind, text, version, kind == "save" and version is not None))
        if version is None:
            if state.exists:
                state.remove()
        else:
            state.update((text, int(version)))
        out = pd.DataFrame(rows, columns=["uri", "gen", "kind", "text", "version", "reindex"])
        yield out.astype({"version": "Int64"})

    return events.select("uri", "gen", "kind", "text").groupBy("uri").applyInPandasWithState(follow, "uri string, gen long, kind string, text string, version long, reindex boolean", "text string, version long", "append", GroupStateTimeout.NoTimeout)
