"""Hand-written fixtures with expected rows."""

import pytest
from pyspark.sql import functions as F

from refloom.functions import text as X
from refloom.operators import documents as D
from refloom.operators import graph as G
from refloom.operators import incremental as C
from refloom.operators import lookup as L
from refloom.operators import postings as P
from refloom.operators import relations as M


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


PERSON = [("impl.go", 11, 9), ("impl.go", 16, 29), ("impl.go", 17, 9), ("user.go", 8, 21), ("user.go", 9, 14), ("user2.go", 7, 18), ("inpkgtest_test.go", 11, 27), ("inpkgtest_test.go", 12, 14)]


def person(spark):
    return spark.createDataFrame([(1, 10, n, f, line, c, c + 6) for n, (f, line, c) in enumerate(PERSON)] + [(1, 10, 0, *PERSON[0], 15)], "target_pkg long, target_id long, src long, file string, line int, col int, end_col int")


def test_references_with_and_without_declaration(spark):
    wanted = spark.createDataFrame([(7, 1, 10)], "query_id long, target_pkg long, target_id long")
    found = P.locations(wanted, person(spark))
    assert rows(found, "file", "line", "col") == sorted(PERSON)
    decl = spark.createDataFrame([(7, "impl.go", 6, 6, 12)], found.schema)
    assert P.dedupe(found.unionByName(decl), ["query_id"]).count() == 9
    edits = P.rename_edits(found, F.lit("Human"))
    assert {r.file: len(r.edits) for r in edits.collect()} == {"impl.go": 3, "user.go": 2, "user2.go": 1, "inpkgtest_test.go": 2}


def test_replace_drops_only_what_the_source_wrote(spark):
    cols = "target_id long, src long, line int"
    index = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (1, 6, 3)], cols)
    fresh = spark.createDataFrame([(3, 5, 9)], cols)
    assert rows(P.replace(index, fresh, spark.createDataFrame([(5,)], "src long")), "target_id", "src", "line") == [(1, 6, 3), (3, 5, 9)]


def test_method_relations(spark):
    methods = spark.createDataFrame([("Greet", 1, 7), ("Speak", 3, 7), ("Speak", 4, 7), ("Gen", 5, 0), ("Two", 6, 7), ("Greet", 6, 7)], "name string, type_id long, fp long")
    req = spark.createDataFrame([(100, "Greet", 7), (101, "Speak", 7), (102, "Gen", 0), (103, "Greet", 7), (103, "Two", 7), (104, "Greet", 8)], "iface long, name string, fp long")
    assert rows(M.confirmed(req, methods)) == [(100, 1), (100, 6), (101, 3), (101, 4), (103, 6)]
    assert rows(M.candidates_all(req, methods)) == [(100, 1), (100, 6), (101, 3), (101, 4), (102, 5), (103, 6), (104, 1), (104, 6)]
    assert (103, 1) in rows(M.candidates_any(req, methods))
    assert rows(M.embedding(req)) == [(100, 103)]
    assert rows(M.with_status(req, methods).where("NOT confirmed"), "iface", "type_id") == [(102, 5), (104, 1), (104, 6)]
    assert M.confirmed(req.limit(0), methods).count() == 0


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string, kind string")


def test_closure_with_cycles(spark):
    e = edges(spark, [("b", "a", "prod"), ("c", "a", "prod"), ("c", "b", "prod"), ("b_test", "b", "test"), ("b_test", "c", "test")])
    seeds = spark.createDataFrame([("a",), ("c",)], "seed string")
    assert rows(G.closure(seeds, e)) == [("a", "a"), ("a", "b"), ("a", "b_test"), ("a", "c"), ("c", "b_test"), ("c", "c")]
    cycle = edges(spark, [("q", "p", "prod"), ("p", "q", "test")])
    assert rows(G.closure(spark.createDataFrame([("p",)], "seed string"), cycle)) == [("p", "p"), ("p", "q")]


def test_order_and_levels(spark):
    assert G.topological_order(["q", "p"], [("q", "p")], [("p", "q")]) == ["p", "q"]
    assert G.topological_order(["c", "b", "a"], [("b", "a"), ("c", "b"), ("c", "a")]) == ["a", "b", "c"]
    e = edges(spark, [("b", "a", "prod"), ("c", "a", "prod"), ("c", "b", "prod")])
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert rows(G.levels(nodes, e)) == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]
    order = spark.createDataFrame([("a", 0), ("b", 1)], "node string, pos int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "z")], "a string, b string")
    assert rows(G.before(pairs, order)) == [("a", "b", True), ("a", "z", False), ("b", "a", False)]


def test_cut_off_stops_at_equal_exports(spark):
    e = edges(spark, [("mid", "leaf", "prod"), ("top", "mid", "prod"), ("top", "leaf", "prod")])
    lv = spark.createDataFrame([("leaf", 0), ("mid", 1), ("top", 2)], "node string, level int")
    leaf = spark.createDataFrame([("leaf",)], "node string")
    units = lambda own, export: spark.createDataFrame([("leaf", own, export), ("mid", "m", "e"), ("top", "t", "e")], "node string, own string, export string")
    redo = lambda own, export: rows(C.reindex(leaf, units("o", "e"), units(own, export), e, lv), "node")
    assert redo("new", "e") == [("leaf",)]
    assert redo("new", "f") == [("leaf",), ("mid",), ("top",)]


def test_revalidate_and_actions(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "unit string, key string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "unit string, key string")
    blobs = spark.createDataFrame([("1",), ("9",)], "key string")
    assert {r.unit: r.stale for r in C.revalidate(cur, old, blobs).collect()} == {"a": None, "b": "key", "c": "missing", "d": "blob"}
    n = spark.createDataFrame([(0,), (64,), (65,)], "n long")
    assert [r[0] for r in n.orderBy("n").select(C.action(F.col("n"))).collect()] == ["none", "repair", "rebuild"]
    assert n.where("n = 65").select(C.action(F.col("n"), seeded=True)).first()[0] == "repair"


def test_unsigned_order_and_limits(spark):
    s = spark.createDataFrame([(-1, "a", "A", 1, 0), (5, "a", "A", 2, 0), (1, "b", "b", 3, 0)], "id_hash long, name_lower string, name string, pkg_hash long, kind int")
    assert [r.id_hash for r in L.workspace_symbol(s, "").collect()] == [5, -1, 1]
    assert L.import_candidates(s, "A", F.lit(2), [0], limit=1).count() == 0  # the limit comes before the filter
    assert L.import_candidates(s, "A", F.lit(2), [0], limit=2).count() == 1
    assert rows(L.name_prefix(s, spark.createDataFrame([("A",)], "prefix string")), "name_lower") == [("a",)]


def test_rank_prefix(spark):
    x = spark.createDataFrame([("Foo",), ("foo",), ("bar",)], "label string")
    assert rows(L.rank_prefix(x, "fo"), "sort_text") == [("0foo",), ("1Foo",)]


def test_ref_at_takes_the_last_one_only(spark):
    refs = spark.createDataFrame([(1, 1, 1, 20, "outer"), (1, 1, 5, 8, "inner")], "doc_id long, line long, col long, end_col long, token string")
    pos = spark.createDataFrame([(1, 1, 6), (1, 1, 9), (1, 1, 2)], "doc_id long, line long, q_col long")
    assert rows(L.ref_at(pos, refs), "q_col", "token") == [(2, "outer"), (6, "inner")]


def test_positions_of_wide_characters(spark):
    d = spark.createDataFrame([("𝄞b", 5), ("𝄞b", 3), ("aé", 4), ("", 1), ("x", 9)], "s string, c int")
    got = [r[0] for r in d.select(X.utf16_column(F.col("s"), F.col("c"))).collect()]
    assert got == [2, None, 2, 0, None]
    assert [r[0] for r in d.select(X.utf16_length(F.col("s"))).collect()] == [3, 3, 2, 0, 1]


def test_dirty_lines(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "b", "c"], n) for n in (1, 2, 3, 9)], "o array<string>, n array<string>, l int")
    assert [r[0] for r in d.select(X.dirty_line(F.col("o"), F.col("n"), F.col("l"))).collect()] == [1, 3, 4, 9]
    e = d.limit(1).select(X.common_ends(F.col("o"), F.col("n")).alias("e")).select("e.*").first()
    assert tuple(e) == (1, 2)


def test_changes_apply_in_order_and_refuse_bad_ranges(spark):
    kind = "t string, e array<struct<start: int, stop: int, text: string>>"
    d = spark.createDataFrame([("hello", [(0, 1, "J"), (5, 5, "!"), (0, 6, "all new")])], kind)
    assert d.select(X.apply_changes(F.col("t"), F.col("e"))).first()[0] == "all new"
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([("hi", [(0, 9, "")])], kind).select(X.apply_changes(F.col("t"), F.col("e"))).collect()


def test_small_string_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(X.ident_before(F.lit("foo.bär_1"))) == "bär_1"
    assert get(X.is_directive(F.lit("//go:build x"))) and not get(X.is_directive(F.lit("// go:x")))
    assert get(X.kind_requested(F.array(F.lit("source")), F.lit("source.fix"))) and not get(X.kind_requested(F.array(F.lit("source")), F.lit("sources")))
    assert get(X.relative(F.lit("/w/a/b"), "/w")) == "a/b" and get(X.relative(F.lit("/x/a"), "/w")) == "/x/a"
    assert get(X.assumed_name(F.lit("example.com/pkg/v2"))) == "pkg"
    assert get(X.active_argument(F.array(F.lit(3), F.lit(8)), F.lit(5), F.lit(2), F.lit(False))) == 1
    assert get(X.active_argument(F.array(F.lit(3), F.lit(8)), F.lit(9), F.lit(2), F.lit(True))) == 1
    assert get(X.percent(F.lit(1), F.lit(0))) == 0 and get(X.percent(F.lit(1), F.lit(3))) == 33
    assert get(X.tail(F.lit("abcdef"), 3)) == "[truncated]\ndef"


def test_document_transforms(spark):
    calls = spark.createDataFrame([("f", "g", 2, 1, 2), ("f", "g", 1, 1, 2)], "caller string, callee string, line int, col int, end_col int")
    r = D.fold_calls(calls, ["caller", "callee"]).first()
    assert [x.line for x in r.ranges] == [1, 2] and r.n_calls == 2
    spans = spark.createDataFrame([(1, 1, 10, 0, "outer"), (1, 3, 5, 1, "inner")], "doc_id long, start int, stop int, depth int, name string")
    assert D.enclosing(spark.createDataFrame([(1, 4)], "doc_id long, line int"), spans).first().enclosing == "outer"
    sy = spark.createDataFrame([("a", 1, "run", "func", None), ("a", 2, "T", "type", None), ("a", 3, "M", "method", "T"), ("a", 4, "N", "method", "U"), ("a", 5, "_", "var", None)], "file string, seq long, name string, kind string, parent string")
    assert [(x.name, x.depth) for x in D.outline(sy).orderBy("place").collect()] == [("T", 0), ("M", 1), ("run", 0), ("N", 0)]
    fn = spark.createDataFrame([("a_test.go", "TestX", "*testing.T"), ("a_test.go", "Testing", "*testing.T"), ("a.go", "TestX", "*testing.T"), ("a_test.go", "Benchmark", "*testing.B")], "file string, name string, param string")
    assert rows(D.test_lenses(fn), "name", "lens") == [("Benchmark", "benchmark"), ("TestX", "test")]
    assert D.folding(spark.createDataFrame([("a", 1, 1), ("a", 2, 5)], "file string, start_line int, stop_line int")).count() == 1


def test_budget_keeps_the_most_recent(spark):
    c = spark.createDataFrame([("u", 1, 3, 60), ("u", 2, 2, 50), ("u", 3, 1, 10)], "who string, entry int, last_used int, size int")
    assert {r.entry: r.kept for r in C.budget(c, ["who"], 100).collect()} == {1: True, 2: False, 3: False}


def test_graph_load_takes_ordinary_packages_first(spark):
    rows_ = [("a", 1, ["x"], None, None), ("a", 2, ["y"], None, None), ("a", 3, ["x", "t"], ["u"], "a"), ("a_test", 4, ["a"], None, "a")]
    p = spark.createDataFrame(rows_, "pkg_path string, seq int, imports array<string>, test_imports array<string>, for_test string")
    nodes, e = G.load(p)
    assert rows(nodes) == [("a",), ("a_test",)]
    assert rows(e, "src", "dst", "kind") == [("a", "t", "test"), ("a", "u", "test"), ("a", "x", "prod"), ("a_test", "a", "prod")]


def test_more_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(X.clean_path(F.lit(p))) for p in ("/a/./b//../c/", "a/../../b", "/..", "")] == ["/a/c", "b", "/", ""]
    assert get(X.absolute(F.lit("x/../y"), "/w")) == "/w/y" and get(X.inside(F.lit("/w/../v"), "/w")) is False and get(X.inside(F.lit("/w/./x"), "/w"))
    assert get(X.word_places(F.lit("foo xfoo foo. éfoo foo"), F.lit("foo"))) == [1, 10, 17, 21] and get(X.word_places(F.lit("none"), F.lit("foo"))) == []
    long = " ".join(["foo"] * 300)
    assert get(X.word_places(F.lit(long), F.lit("foo"))) == [1 + 4 * k for k in range(300)]
    assert get(X.receiver(F.lit("(*T).M"))) == "T" and get(X.receiver(F.lit("T.M"))) == "T" and get(X.receiver(F.lit("f"))) is None
    assert tuple(get(X.diagnostic(F.lit('"a/b" imported and not used')))) == ("unused-import", "a/b", "warning")
    assert get(X.generic_name(F.lit("example.com/a-b/v3"))) == "a_b" and get(X.generic_name(F.lit("v2"))) == "_"
    assert get(X.merged_settings(F.lit('{"a": 5, "c": 1}'), {"a": 1, "b": 2})) == {"a": 5, "b": 2} and get(X.merged_settings(F.lit("broken"), {"a": 1})) == {"a": 1}
    assert get(X.memory_limit(F.lit(10), 0.5, 7)) == 7 and get(X.memory_limit(F.lit(100), 0.5, 7)) == 50


def test_tails_keep_whole_characters(spark):
    one = spark.range(1)
    for n in range(1, 12):
        s = "aé𝄞b" * 3
        got = one.select(X.tail(F.lit(s), n)).first()[0]
        want = s.encode()[-n:].decode(errors="ignore")
        assert got == "[truncated]\n" + want


def test_completion_order_and_chain(spark):
    s = spark.createDataFrame([("u", "Foo"), ("u", "foo"), ("u", "bar"), ("v", "foo")], "scope string, label string")
    asked = spark.createDataFrame([("u", "fo")], "scope string, prefix string")
    assert rows(L.completions(asked, s), "sort_text") == [("0foo",), ("1Foo",)]
    q = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    tiers = [("a", spark.createDataFrame([(1, "x")], "k long, answer string")), ("b", spark.createDataFrame([(1, "y"), (2, "z")], "k long, answer string"))]
    assert rows(L.chain(q, ["k"], tiers), "k", "answer", "tier") == [(1, "x", "a"), (2, "z", "b")]


def test_first_symbol_of_an_id(spark):
    s = spark.createDataFrame([(1, 10, "late", 9), (1, 10, "first", 2)], "pkg_hash long, id_hash long, name string, seq int")
    assert rows(L.symbol_by_id(spark.createDataFrame([(1, 10)], "pkg_hash long, id_hash long"), s), "name") == [("first",)]


def test_failures_go_upwards(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 9)], "src long, dst long")
    assert rows(C.failed_upwards(spark.createDataFrame([(1,), (2,)], "node long"), e), "node", "cause") == [(2, 1), (3, 1)]
    pins = spark.createDataFrame([("u", 1, 3, 60, False), ("u", 2, 2, 50, True), ("u", 3, 1, 90, True)], "who string, entry int, last_used int, size int, pinned boolean")
    assert {r.entry: r.kept for r in C.budget(pins, ["who"], 100).collect()} == {1: False, 2: True, 3: True}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from refloom.sources import scratch

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    session = lambda master, **conf: SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.root(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch.root(session("local-cluster[2,1,1024]"))
    assert scratch.root(session("local[2]")).startswith("file://") and scratch.root(session("yarn", **{"spark.checkpoint.dir": "hdfs://x"})) == "hdfs://x"


def shuffled(df):
    """Rows of the result, and rows that its plan writes to shuffles."""
    run = df._jdf.queryExecution()
    made = run.toRdd().count()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        n, below = plan.metrics().get("shuffleRecordsWritten"), plan.children()
        return (n.get().value() if n.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return made, walk(run.executedPlan())


#: rows of each relation over 1,000 interfaces and 1,000 types that are all alike
ALIKE = {
    "confirmed": 1_000_000,
    "method_names": 1_000_000,
    "satisfied": 1000,
    "subtypes": 1_999_000,
    "with_status": 1_000_000,
    "method_pairs": 1_000_000,
    "embedding": 999_000,
    "ordered_subtypes": 1_999_000,
    "candidates_all": 1_000_000,
    "candidates_any": 1_000_000,
    "corresponding": 1_000_000,
}


@pytest.mark.parametrize("name", ALIKE)
def test_pairs_of_copies_are_not_shuffled(spark, name):
    req = spark.range(1000).selectExpr("id + 5000 AS iface", "'A' AS name", "5L AS fp")
    own = spark.range(1000).selectExpr("id AS type_id", "'A' AS name", "5L AS fp")
    given = [req] if name == "embedding" else [req, own]
    if name == "corresponding":
        given = [req.selectExpr("iface AS query_id", "iface AS type_id", "name"), *given]
    made, moved = shuffled(getattr(M, name)(*given))
    assert made == ALIKE[name] and moved < 5000


def test_pairs_of_classes_are_not_shuffled(spark):
    few = spark.range(300).selectExpr("id AS iface", "'A' AS name", "5L AS fp")
    many = spark.range(1000, 4000).selectExpr("id AS iface", "explode(array('A', concat('N', id), concat('M', id % 7))) AS name", "5L AS fp")
    made, moved = shuffled(M.embedding(few.unionAll(many)))
    assert made == 300 * 299 + 300 * 3000 and moved < 10_000


@pytest.mark.parametrize("ids", [(1, 2), (-(1 << 63), (1 << 63) - 1), (-7, 1 << 62)])
def test_calls_without_shuffled_tokens(spark, tmp_path, ids):
    from refloom.plans.catalogue import QUERIES

    a, b = ids
    texts = [(a, "foo bar\nfoo\n\n\n\nbar foo", "s"), (b, " bar foo baz baz" + " foo" * 3000, "s"), (None, "foo", "s")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    calls = QUERIES["incoming_calls"](spark, str(tmp_path))
    want = [("bar", a, 1, 1, 6, 1), ("bar", b, 0, 1, 1, 2), ("baz", b, 0, 1, 1, 14), ("foo", a, 0, 1, 2, 1), ("foo", a, 1, 1, 6, 5), ("foo", b, 0, 3001, 1, 6)]
    assert rows(calls, "token", "doc_id", "caller", "n_calls", "first_line", "first_col") == want
    assert shuffled(calls)[1] < 100


@pytest.mark.parametrize("sent", [None, 0])
def test_types_of_sets_without_copies_are_not_shuffled(spark, monkeypatch, sent):
    import random

    if sent is not None:
        monkeypatch.setattr(M, "SENT", sent)  # types don't meet interfaces as pages
    r = random.Random(3)
    pool = [(f"N{k % 9}", k // 9) for k in range(45)]
    req = {i + 5000: set(r.sample(pool, r.choice([1, 1, 2, 3, 5, 13]))) for i in range(300)}
    own = {7 * i - 900: set(r.sample(pool, 30)) for i in range(2200 if sent is None else 90)}
    own |= {t + 1: e for t, e in list(own.items())[:3]}
    frame = lambda sets, key: spark.createDataFrame([(k, n, fp) for k, s in sets.items() for n, fp in s], f"{key} long, name string, fp long")
    ok = {(i, t) for i, q in req.items() for t, e in own.items() if q <= e and all(fp for _, fp in q)}
    of = {}
    for i, t in sorted(ok):
        of.setdefault(t, []).append(i)
    per = M.satisfied(frame(req, "iface"), frame(own, "type_id"))
    assert rows(per, "type_id", "n", "least", "most") == sorted((t, len(x), x[0], x[-1]) for t, x in of.items())
    pairs = M.confirmed(frame(req, "iface"), frame(own, "type_id"))
    assert rows(pairs, "iface", "type_id") == sorted(ok)
    if sent is None:
        assert len(ok) > 100_000 and shuffled(pairs)[1] < 5000 and shuffled(per)[1] < 20_000
