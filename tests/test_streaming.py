from datetime import datetime, timedelta

from pyspark.sql import functions as F

from refloom.streaming import gates as T

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(g, p, START + timedelta(seconds=s), z, d, False) for g, p, s, z, d in rows], "gen long, path long, mtime timestamp, size long, is_delete boolean, is_module boolean")


def run(spark, tmp_path, make, batches, schema, name):
    """The rows that a stream gives for batches that come one after another."""
    for n, b in enumerate(batches):
        b.coalesce(1).write.parquet(str(tmp_path / f"{name}/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / f"{name}/*"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_debounce_batch_and_stream_agree(spark, tmp_path):
    e = events(spark, [(1, 1, 0, 1, False), (2, 1, 1, 1, False), (3, 1, 10, 1, False), (4, 2, 0, 1, False)])
    batch = sorted((r.path, r.n) for r in T.sessions(e, 5, ["path"]).collect())
    assert batch == [(1, 1), (1, 2), (2, 1)]
    e.write.parquet(str(tmp_path / "in"))
    late = events(spark, [(9, 9, 1000, 1, False)])  # moves the watermark past the others
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.stream_sessions(stream, 5, ["path"], "20 seconds").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.path, r.n) for r in spark.sql("SELECT * FROM sessions").collect())
    assert got == batch  # the late event moves the watermark past them, and stays open itself


def test_duplicates_are_dropped_and_deletions_forget(spark, tmp_path):
    rows = [(1, 0, 5, 9, False), (2, 0, 5, 9, False), (3, 0, 5, 8, False), (4, 0, 5, None, False), (5, 0, 5, None, False), (6, 0, 5, 9, False), (7, 0, 5, 9, True), (8, 0, 5, 9, False), (9, 0, 6, 9, False), (10, 1, 6, 9, False), (11, 1, 6, 9, False)]
    schema = "gen long, path long, mtime timestamp, size long, hash long, is_delete boolean"
    table = lambda part: spark.createDataFrame([(g, 1, START + timedelta(seconds=s), z, h, d) for g, s, z, h, d in part], schema)
    want = [1, 3, 4, 5, 6, 7, 8, 9, 10]  # an event without a hash is never a duplicate
    assert sorted(r.gen for r in T.changed_only(table(rows)).collect()) == want
    got = run(spark, tmp_path, T.stream_changed_only, [table([r]) for r in rows], table(rows).schema, "dedup")
    assert sorted(r.gen for r in got) == want


def test_documents_follow_their_notifications(spark, tmp_path):
    rows = [(1, "a", "change", "early"), (2, "a", "open", "one"), (3, "a", "change", "two"), (4, "b", "open", "x"), (5, "a", "save", None), (6, "a", "close", None), (7, "a", "save", None), (8, "a", "open", "three"), (9, "b", "open", "y")]
    e = lambda part: spark.createDataFrame([(u, g, k, t) for g, u, k, t in part], "uri string, gen long, kind string, text string")
    want = [(1, None, None, False), (2, "one", 1, False), (3, "two", 2, False), (4, "x", 1, False), (5, "two", 2, True), (6, None, None, False), (7, None, None, False), (8, "three", 1, False), (9, "y", 1, False)]
    tidy = lambda got: sorted((r.gen, r.text, r.version, r.reindex) for r in got)
    assert tidy(T.document_state(e(rows)).collect()) == want
    got = run(spark, tmp_path, T.stream_documents, [e([r]) for r in rows], e(rows).schema, "documents_state")
    assert tidy(got) == want
    opens = T.pending_opens(e(rows), F.lit(6)).collect()
    assert sorted((r.uri, r.gen) for r in opens) == [("a", 2), ("b", 4)]
    assert [(r.gen, r.waits_for) for r in T.in_order(e(rows), "uri", "gen").where("uri = 'b'").orderBy("gen").collect()] == [(4, 0), (9, 1)]


def test_newest_generation(spark, tmp_path):
    e = events(spark, [(2, 1, 0, 20, False), (1, 1, 1, 10, False), (7, 2, 0, 70, False)])
    assert sorted((r.path, r.gen, r["size"]) for r in T.latest(e).collect()) == [(1, 2, 20), (2, 7, 70)]
    for n, g in enumerate((5, 3, 6)):  # one file for each trigger: 3 comes late
        events(spark, [(g, 1, n, 0, False)]).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = T.commit_newest(stream).writeStream.format("memory").queryName("commits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.gen for r in spark.sql("SELECT * FROM commits").collect()) == [5, 6]


def test_routing(spark):
    d = spark.createDataFrame([(False, True, False), (True, False, True), (False, False, False), (False, False, True)], "d boolean, m boolean, k boolean")
    assert [r[0] for r in d.select(T.route(F.col("d"), F.col("m"), F.col("k"))).collect()] == ["reload", "graph", "graph", "dirty"]
