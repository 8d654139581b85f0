"""Registered queries of document features, storage, incremental maintenance and synchronisation, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from refloom.functions import text as X
from refloom.operators import documents as D
from refloom.operators import graph as G
from refloom.operators import incremental as C
from refloom.operators import lookup as L
from refloom.operators import relations as M
from refloom.plans.catalogue import _E, _SPANS, GX, LX, R, _spans
from refloom.plans.registry import query
from refloom.sources import store
from refloom.sources.scratch import root
from refloom.sources.tables import Graph, Lexical, Relational, changes, table
from refloom.streaming import gates as T


def _scratch(spark, name: str) -> str:
    return f"{root(spark)}/refloom/{name}-{uuid.uuid4().hex}"


# lookups and predicates


@query(R + "SELECT src AS unit, target_id, file, line, col FROM post WHERE target_id = src")
def refs_in_unit(spark, sf):
    """Places of one id in one unit; every unit is asked for the symbol of its own number."""
    r = Relational(spark, sf)
    asked = r.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_suppkey").alias("target_id"))
    return r.postings().join(asked, ["src", "target_id"]).select(F.col("src").alias("unit"), "target_id", "file", "line", "col")


@query(R + "SELECT name, type_id, fp FROM ent WHERE name IN (SELECT p_brand FROM part WHERE p_size = 50)")
def exact_method_names(spark, sf):
    r = Relational(spark, sf)
    return L.exact_names(r.methods(), r.part.where("p_size = 50").select(F.col("p_brand").alias("name"))).select("name", "type_id", "fp")


@query("SELECT p_size AS id_hash, count(DISTINCT p_brand || '#' || p_name) AS n FROM part GROUP BY p_size HAVING count(DISTINCT p_brand || '#' || p_name) > 1")
def symbol_collisions(spark, sf):
    """Hashes that stand for several strings; sizes serve as hashes, so there are some."""
    return L.collisions(table(spark, sf, "part").select(F.col("p_size").alias("id_hash"), F.concat("p_brand", F.lit("#"), "p_name").alias("symbol_id")))


@query("SELECT p_brand || '#' || p_name AS symbol_id, p_brand AS pkg, p_name AS object, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY p_brand, p_name")
def symbol_info(spark, sf):
    p = table(spark, sf, "part")
    symbols = p.groupBy(F.col("p_brand").alias("pkg"), F.col("p_name").alias("object")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
    # a brand holds a # of its own, so the two parts are told apart by another mark, as a package path has none
    ids = p.select(F.concat(F.translate("p_brand", "#", "\u0001"), F.lit("#"), "p_name").alias("symbol_id")).distinct()
    found = L.symbol_info(ids, symbols.withColumn("pkg", F.translate("pkg", "#", "\u0001")))
    back = lambda c: F.translate(c, "\u0001", "#")
    return found.select(back("symbol_id").alias("symbol_id"), back("pkg").alias("pkg"), "object", "first", "n")


@query(R + "SELECT unit, file, row_number() OVER (PARTITION BY unit ORDER BY file) - 1 AS idx FROM snap WHERE is_new")
def file_index(spark, sf):
    """The number of each file in its unit."""
    w = Window.partitionBy("unit").orderBy("file")
    return Relational(spark, sf).snapshot(True).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 2 = 0 THEN p_type END AS doc, p_brand || coalesce(chr(10) || CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 2 = 0 THEN p_type END, '') AS hover FROM part")
def doc_by_key(spark, sf):
    """A declaration's documentation, its own before its group's, and the hover text that holds it."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("").alias("spec_doc"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("group_doc"))
    return D.with_doc(p).select("p_partkey", "doc", F.concat("p_brand", F.coalesce(F.concat(F.lit("\n"), "doc"), F.lit(""))).alias("hover"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_brand END AS receiver FROM part")
def method_receiver(spark, sf):
    m = F.when(F.col("p_size") % 3 == 0, F.concat("p_brand", F.lit("."), "p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("(*"), "p_brand", F.lit(")."), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.receiver(m).alias("receiver"))


_MESSAGES = """m AS (SELECT event_id, CASE event_type WHEN 'signup' THEN '"pkg/' || user_id || '" imported and not used' WHEN 'error' THEN 'declared and not used: v' || user_id WHEN 'click' THEN 'undefined: f' || user_id ELSE 'missing return' END AS message FROM events)"""


@query("WITH " + _MESSAGES + """ SELECT event_id, CASE WHEN message LIKE '"%' THEN 'unused-import' WHEN message LIKE 'declared%' THEN 'unused' WHEN message LIKE 'undefined%' THEN 'undefined' ELSE 'other' END AS code,
 regexp_extract(message, '(?:pkg/|: )([a-z]?[0-9]+)', 0) AS found, CASE WHEN message LIKE '"%' OR message LIKE 'declared%' THEN 'warning' ELSE 'error' END AS severity FROM m""")
def diagnostic_codes(spark, sf):
    """What a checker's messages are about; unused things are warnings."""
    say = F.when(F.col("event_type") == "signup", F.concat(F.lit('"pkg/'), "user_id", F.lit('" imported and not used'))).when(F.col("event_type") == "error", F.concat(F.lit("declared and not used: v"), "user_id")).when(F.col("event_type") == "click", F.concat(F.lit("undefined: f"), "user_id")).otherwise("missing return")
    d = table(spark, sf, "events").select("event_id", X.diagnostic(say).alias("d"))
    mark = F.when(F.col("d.code") == "unused-import", "").when(F.col("d.name") != "", ": ").otherwise("")
    return d.select("event_id", "d.code", F.concat(mark, "d.name").alias("found"), "d.severity")


@query("SELECT event_id, '/w/' || user_id || '/' || event_type AS clean, user_id || '/' || event_type AS rel, CASE WHEN event_id % 2 = 0 THEN '/w/' || event_type ELSE '/' || event_type END AS abs, event_id % 2 = 0 AS inside FROM events")
def paths(spark, sf):
    """Paths are cleaned, made relative to a root and absolute again; some lead out of it."""
    e = table(spark, sf, "events")
    raw = F.concat(F.lit("/w//"), "user_id", F.lit("/./x/../"), "event_type")
    other = F.concat(F.when(F.col("event_id") % 2 == 0, "a/..").otherwise("a/../.."), F.lit("/"), "event_type")
    d = e.select("event_id", X.clean_path(raw).alias("clean"), X.absolute(other, "/w").alias("abs"))
    return d.select("event_id", "clean", X.relative(F.col("clean"), "/w").alias("rel"), "abs", X.inside(F.col("abs"), "/w").alias("inside"))


# method relations

_BY_NAME = """WITH rq AS (SELECT DISTINCT p_name AS iface, p_brand || p_type AS name FROM part WHERE p_size > 40), hv AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS type_id, p_brand || p_type AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40),
nd AS (SELECT iface, count(*) AS n FROM rq GROUP BY 1) """


@query(_BY_NAME + """SELECT r.iface, h.type_id AS other, false AS is_interface FROM rq r JOIN hv h USING (name) JOIN nd n ON n.iface = r.iface GROUP BY r.iface, h.type_id, n.n HAVING count(*) = n.n
UNION ALL SELECT r.iface, h.iface, true FROM rq r JOIN rq h ON h.name = r.name AND h.iface <> r.iface JOIN nd n ON n.iface = r.iface GROUP BY r.iface, h.iface, n.n HAVING count(*) = n.n""")
def candidates_either(spark, sf):
    """Types and interfaces that have all of an interface's names; interfaces are names of large parts."""
    part, combo = table(spark, sf, "part"), F.concat("p_brand", "p_type").alias("name")
    required = part.where("p_size > 40").select(F.col("p_name").alias("iface"), combo).distinct()
    own = table(spark, sf, "lineitem").where("l_quantity > 40").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").cast("string").alias("type_id"), combo).distinct()
    return M.candidates_either(required, own)


@query(R + "SELECT DISTINCT l_partkey AS type_id, l_suppkey AS method_id FROM lineitem WHERE l_partkey IN (SELECT id_hash FROM sym WHERE kind IN (0, 1)) AND l_suppkey IN (SELECT id_hash FROM sym WHERE kind IN (2, 3))")
def kind_checked_entries(spark, sf):
    r = Relational(spark, sf)
    entries = r.line.select(F.col("l_partkey").alias("type_id"), F.col("l_suppkey").alias("method_id")).distinct()
    return M.kind_checked(entries, r.symbols(), [0, 1], [2, 3])


@query(R + "SELECT c.iface, c.type_id, o.iface IS NOT NULL AS confirmed FROM (SELECT iface, type_id FROM (SELECT DISTINCT iface, name FROM req) JOIN (SELECT DISTINCT type_id, name FROM ent) USING (name) JOIN (SELECT iface, count(DISTINCT name) AS n FROM req GROUP BY 1) USING (iface) GROUP BY iface, type_id, n HAVING count(*) = n) c LEFT JOIN ok o ON o.iface = c.iface AND o.type_id = c.type_id")
def candidate_status(spark, sf):
    """Candidates by name, and whether fingerprints confirm them; the others are left to a decoder."""
    r = Relational(spark, sf)
    return M.with_status(r.required(), r.provided()).select("iface", "type_id", "confirmed")


@query(R + "SELECT DISTINCT -q.iface - 1 AS query_id, o.type_id AS other_id, q.name FROM req q JOIN ok o ON o.iface = q.iface")
def corresponding_methods(spark, sf):
    """Of every interface's methods those of the types that satisfy it; interfaces have negative ids, so that no type has one."""
    r = Relational(spark, sf)
    required = r.required().withColumn("iface", -F.col("iface") - 1)
    asked = required.select(F.col("iface").alias("query_id"), F.col("iface").alias("type_id"), "name")
    return M.corresponding(asked, required, r.provided())


@query("SELECT iface, name, type_id, arg_min(method_id, {'seq': seq, 'method_id': method_id}) AS method_id FROM (SELECT l_orderkey AS iface, p_brand AS name, l_suppkey AS type_id, l_partkey AS method_id, l_linenumber AS seq FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY ALL")
def first_methods(spark, sf):
    """Of each candidate the first method of a name."""
    pairs = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return M.first_method(pairs.select(F.col("l_orderkey").alias("iface"), F.col("p_brand").alias("name"), F.col("l_suppkey").alias("type_id"), F.col("l_partkey").alias("method_id"), F.col("l_linenumber").alias("seq")))


# order


@query(R + "SELECT target_id, src, row_number() OVER (PARTITION BY target_id ORDER BY src <> target_pkg, src) AS place FROM (SELECT DISTINCT target_id, target_pkg, src FROM post)")
def own_package_first(spark, sf):
    """Items of a hierarchy: those of the asked unit first, then the others by unit."""
    w = Window.partitionBy("target_id").orderBy(F.col("src") != F.col("target_pkg"), "src")
    return Relational(spark, sf).postings().select("target_id", "target_pkg", "src").distinct().select("target_id", "src", F.row_number().over(w).cast("long").alias("place"))


@query(R + "SELECT file, line, col, target_id, row_number() OVER (PARTITION BY file ORDER BY line, col, target_id, src) AS place FROM post")
def ref_order(spark, sf):
    """References of a file by place, equal places in a fixed order."""
    w = Window.partitionBy("file").orderBy("line", "col", "target_id", "src")
    return Relational(spark, sf).postings().withColumn("place", F.row_number().over(w).cast("long")).select("file", "line", "col", "target_id", "place")


@query("SELECT event_type AS phase, CAST(max(floor(value)) AS BIGINT) AS peak, arg_max(event_id, {'v': value, 'e': -event_id}) AS at FROM events GROUP BY event_type")
def peak_memory(spark, sf):
    """The highest measure of each phase and when it was."""
    best = F.max(F.struct("value", (-F.col("event_id")).alias("e"))).alias("b")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("phase")).agg(best).select("phase", F.floor("b.value").alias("peak"), (-F.col("b.e")).alias("at"))


# graphs


@query("""WITH p AS (SELECT 'p' || (p_partkey // 2) AS path, p_partkey AS seq, ['p' || (p_partkey // 3), 'p' || (p_partkey // 5)] AS imports, ['p' || (p_partkey // 7)] AS tests, CASE p_size % 5 WHEN 1 THEN 'p' || (p_partkey // 2) WHEN 2 THEN 'q' END AS for_test FROM part),
own AS (SELECT * FROM p WHERE for_test IS NULL OR for_test <> path), first AS (SELECT path, arg_min({'i': imports, 't': tests}, {'late': for_test IS NOT NULL, 'seq': seq}) AS x FROM own GROUP BY path),
prod AS (SELECT DISTINCT path AS src, unnest(x.i) AS dst FROM first),
test AS (SELECT DISTINCT src, dst FROM (SELECT path AS src, unnest(x.t) AS dst FROM first UNION ALL SELECT path, unnest(list_concat(imports, tests)) FROM p WHERE for_test = path) WHERE src <> dst)
SELECT src, dst, 'prod' AS kind FROM prod UNION ALL SELECT src, dst, 'test' FROM test WHERE (src, dst) NOT IN (SELECT src, dst FROM prod)""")
def graph_load(spark, sf):
    """Package variants become nodes and edges: ordinary packages first, test variants only add imports."""
    name = lambda n: F.concat(F.lit("p"), F.floor(F.col("p_partkey") / n).cast("string"))
    p = table(spark, sf, "part").select(name(2).alias("pkg_path"), F.col("p_partkey").alias("seq"), F.array(name(3), name(5)).alias("imports"), F.array(name(7)).alias("test_imports"), F.when(F.col("p_size") % 5 == 1, name(2)).when(F.col("p_size") % 5 == 2, "q").alias("for_test"))
    return G.load(p)[1]


@query(GX + ", hit(node) AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 UNION SELECT e.src FROM hit h JOIN (SELECT src, dst FROM prod UNION SELECT src, dst FROM edge WHERE kind = 'test') e ON e.dst = h.node) SELECT node FROM hit")
def affected_units(spark, sf):
    """Units whose old or new dependencies reach a changed one; the tests' imports are new."""
    g = Graph(spark, sf)
    changed = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return G.affected(changed, g.prod, g.edges)


@query(GX + "SELECT DISTINCT seed, 'd' || (node % 10) AS dir FROM clo")
def closure_dirs(spark, sf):
    """The folders of all units of each closure."""
    g = Graph(spark, sf)
    return G.closure(g.nodes.select(F.col("node").alias("seed")), g.edges).select("seed", F.concat(F.lit("d"), (F.col("node") % 10).cast("string")).alias("dir")).distinct()


@query(GX + "SELECT src, dst, kind FROM edge")
def graph_cache(spark, sf):
    """The graph saved and loaded again; a manifest that differs is refused."""
    g, path, manifest = Graph(spark, sf), _scratch(spark, "graph"), {"patterns": "./...", "flags": "", "digest": "1"}
    store.save_graph(g.nodes, g.edges, path, manifest)
    kinds = ("node BIGINT, is_root BOOLEAN", "src BIGINT, dst BIGINT, kind STRING")
    if store.load_graph(spark, path, manifest | {"digest": "2"}, *kinds) is not None:
        raise AssertionError("a cache of other module files was taken")
    return store.load_graph(spark, path, manifest, *kinds)[1]


@query(GX + """, bad(seed, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_size = 50 UNION SELECT b.seed, p.src FROM bad b JOIN prod p ON p.dst = b.node)
SELECT node, min(seed) AS cause FROM bad WHERE seed <> node GROUP BY node""")
def failed_dependents(spark, sf):
    """What can't be built because something below it failed."""
    failed = table(spark, sf, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))
    return C.failed_upwards(failed, Graph(spark, sf).prod)


# documents


@query("""WITH s AS (SELECT p_size AS file, p_partkey AS seq, CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'type' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'method' WHEN p_type = 'SMALL' THEN 'func' ELSE 'var' END AS kind, CASE WHEN p_type = 'LARGE' AND p_partkey % 2 = 0 THEN '_' WHEN p_type IN ('STANDARD', 'ECONOMY') THEN p_brand ELSE p_name END AS name, p_brand AS parent FROM part),
n AS (SELECT * FROM s WHERE NOT (name = '_' AND kind IN ('var', 'const'))), t AS (SELECT file, name, min(seq) AS up FROM n WHERE kind = 'type' GROUP BY ALL),
x AS (SELECT n.*, CASE WHEN n.kind = 'method' THEN t.up END AS up FROM n LEFT JOIN t ON t.file = n.file AND t.name = n.parent)
SELECT file, seq, name, kind, CASE WHEN up IS NULL THEN 0 ELSE 1 END AS depth, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN kind = 'type' OR up IS NOT NULL THEN 0 ELSE 1 END, coalesce(up, seq), CASE WHEN up IS NULL THEN 0 ELSE 1 END, seq) AS place FROM x""")
def document_outline(spark, sf):
    kind = F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), "type").when(F.col("p_type").isin("MEDIUM", "PROMO"), "method").when(F.col("p_type") == "SMALL", "func").otherwise("var")
    name = F.when((F.col("p_type") == "LARGE") & (F.col("p_partkey") % 2 == 0), "_").when(kind == "type", F.col("p_brand")).otherwise(F.col("p_name"))
    s = table(spark, sf, "part").select(F.col("p_size").alias("file"), F.col("p_partkey").alias("seq"), name.alias("name"), kind.alias("kind"), F.col("p_brand").alias("parent"))
    return D.outline(s)


@query(R + "SELECT u.pkg_hash AS scope, u.prefix, s.id_hash, (CASE WHEN starts_with(s.name, u.prefix) THEN '0' ELSE '1' END) || s.name AS sort_text FROM (SELECT DISTINCT pkg_hash, CASE WHEN pkg_hash % 2 = 0 THEN upper(substr(name, 1, 2)) ELSE substr(name, 1, 2) END AS prefix FROM sym) u JOIN sym s ON s.pkg_hash = u.pkg_hash AND starts_with(s.name_lower, lower(u.prefix))")
def completion(spark, sf):
    """In each unit, for the first letters of each of its names: what is in scope, ranked."""
    s = Relational(spark, sf).symbols().select(F.col("pkg_hash").alias("scope"), F.col("name").alias("label"), "id_hash")
    two = F.substring("label", 1, 2)
    asked = s.select("scope", F.when(F.col("scope") % 2 == 0, F.upper(two)).otherwise(two).alias("prefix")).distinct()
    return L.completions(asked, s).select("scope", "prefix", "id_hash", "sort_text")


@query("""SELECT n_nationkey AS scope, '20' || n_name AS sort_text, count(DISTINCT s_suppkey) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name
UNION ALL SELECT n_nationkey, '30' || c_mktsegment, count(DISTINCT c_custkey) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, c_mktsegment""")
def unimported_completion(spark, sf):
    """What isn't imported comes behind what is: packages with rank 2, their members with rank 3."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("scope"), "n_name")
    asked = n.select("scope", F.lit("").alias("prefix"))
    packages = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("scope")).select("scope", F.col("n_name").alias("label"), F.col("s_suppkey").alias("k"))
    members = table(spark, sf, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("k"))
    both = L.completions(asked, packages, "2").unionByName(L.completions(asked, members, "3"))
    return both.groupBy("scope", "sort_text").agg(F.count_distinct("k").alias("n"))


_U16 = """, u16 AS (SELECT doc_id, line, k, token, end_col, col, CAST(sum(u) OVER (PARTITION BY doc_id, line ORDER BY k) AS BIGINT) AS stop, CAST(length(token) AS BIGINT) AS len FROM (SELECT f.doc_id, f.line, f.k, f.token, t.col, t.end_col, length(gs) + length(f.token) + len(regexp_extract_all(gs, '[\\x{10000}-\\x{10FFFF}]')) AS u
 FROM (SELECT doc_id, line, unnest(t) AS token, unnest(g[1:len(t)]) AS gs, unnest(range(1, len(t) + 1)) AS k FROM cut WHERE len(t) > 0) f JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY col) AS k FROM tok) t ON t.doc_id = f.doc_id AND t.line = f.line AND t.k = f.k)) """


def _editor_tokens(spark, sf):
    """(doc_id, line, start, length, col, token): tokens at 0-based lines and UTF-16 columns."""
    x = Lexical(spark, sf)
    t = x.tokens.join(x.lines(), ["doc_id", "line"])
    return t.select("doc_id", (F.col("line") - 1).alias("line"), X.utf16_column(F.col("text"), F.col("col").cast("int")).alias("start"), X.utf16_length(F.col("token")).alias("length"), "col", "token")


@query(LX + _U16 + "SELECT doc_id, line - 1 AS line, stop - len AS start, stop AS stop FROM u16")
def editor_ranges(spark, sf):
    """Byte places as an editor's ranges."""
    return _editor_tokens(spark, sf).select("doc_id", "line", "start", (F.col("start") + F.col("length")).alias("stop"))


@query(LX + _U16 + """, e AS (SELECT doc_id, line - 1 AS line, stop - len AS start, len AS length, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 1 WHEN token IN ('func', 'type', 'var') THEN 15 ELSE 8 END AS kind, CASE WHEN regexp_matches(token, '^[A-Z][A-Z]') THEN 4 ELSE 0 END AS modifiers FROM u16)
SELECT doc_id, line, start, line - coalesce(lag(line) OVER w, 0) AS d_line, CASE WHEN coalesce(lag(line) OVER w, 0) = line THEN start - coalesce(lag(start) OVER w, 0) ELSE start END AS d_start, length, kind, modifiers FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY line, start)""")
def encoded_tokens(spark, sf):
    """Classified tokens in the protocol's encoding."""
    t, name = _editor_tokens(spark, sf), F.col("token")
    kind = F.when(name.rlike("^[A-Z]"), 1).when(name.isin("func", "type", "var"), 15).otherwise(8)
    return D.encode_tokens(t.select("doc_id", "line", "start", "length", kind.alias("kind"), F.when(name.rlike("^[A-Z][A-Z]"), 4).otherwise(0).alias("modifiers")))


@query(LX + "SELECT doc_id, line + 2 AS line, CASE WHEN line = 1 THEN 5 ELSE 1 END AS col, CAST(strlen(text) AS BIGINT) AS bytes FROM lines WHERE text <> ''")
def multiline_tokens(spark, sf):
    """Texts as tokens that begin at column 5 of line 3, cut at line ends."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(3).alias("line"), F.lit(5).alias("col"), "text")
    return D.split_lines(d).select("doc_id", F.col("line").cast("long").alias("line"), "col", F.octet_length("text").cast("long").alias("bytes"))


@query(LX + "SELECT doc_id, line, col FROM tok WHERE line * 10000 + col < 30000 AND line * 10000 + end_col > 15000")
def token_range(spark, sf):
    """Tokens that overlap a range from the first line's middle to the third line."""
    t = Lexical(spark, sf).tokens.select("doc_id", (F.col("line") * 10000 + F.col("col")).alias("start"), (F.col("line") * 10000 + F.col("end_col")).alias("stop"), "line", "col")
    ranges = table(spark, sf, "documents").select("doc_id", F.lit(15000).alias("from"), F.lit(30000).alias("to"))
    return D.in_ranges(t, ranges).select("doc_id", "line", "col")


@query(LX + _SPANS + """, n AS (SELECT doc_id, start, stop FROM outer_span UNION SELECT doc_id, start + 1, stop FROM outer_span WHERE stop - start > 1 UNION SELECT doc_id, 1, max(line) + 1 FROM lines GROUP BY doc_id)
SELECT l.doc_id, l.line, n.start, n.stop, row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY n.stop - n.start, n.start) AS step FROM lines l JOIN n ON n.doc_id = l.doc_id AND n.start <= l.line AND l.line < n.stop""")
def selection_ranges(spark, sf):
    """Of every line the ranges that hold it, from the inner block to the whole document."""
    x = Lexical(spark, sf)
    whole = x.lines().groupBy("doc_id").agg(F.lit(1).cast("long").alias("start"), (F.max("line") + 1).alias("stop"))
    nodes = _spans(x).select("doc_id", "start", "stop").unionByName(whole).distinct()
    s = D.selection_ranges(x.lines().select("doc_id", F.col("line").alias("at")), nodes)
    return s.select("doc_id", F.col("at").alias("line"), "start", "stop", F.col("step").cast("long").alias("step"))


@query(R + "SELECT src AS unit, file, target_pkg, count(*) AS n, min(line) AS first FROM post WHERE target_pkg <> src GROUP BY ALL")
def package_name_refs(spark, sf):
    """What each file refers to by each of its imports."""
    p = Relational(spark, sf).postings().where("target_pkg != src")
    return p.groupBy(F.col("src").alias("unit"), "file", "target_pkg").agg(F.count("*").alias("n"), F.min("line").alias("first"))


@query("""WITH f AS (SELECT 'f' || p_size || CASE WHEN p_size % 3 = 0 THEN '_test.go' ELSE '.go' END AS file, p_partkey AS line, CASE p_type WHEN 'STANDARD' THEN 'Test' || p_name WHEN 'ECONOMY' THEN 'Testing' WHEN 'MEDIUM' THEN 'Benchmark' WHEN 'PROMO' THEN 'Test' ELSE p_name END AS name, CASE WHEN p_type = 'MEDIUM' THEN '*testing.B' ELSE '*testing.T' END AS param, p_type FROM part)
SELECT file, lens, min(line) AS first, count(*) AS n FROM (SELECT file, line, CASE WHEN regexp_matches(name, '^Test([^a-z]|$)') AND param = '*testing.T' THEN 'test' WHEN regexp_matches(name, '^Benchmark([^a-z]|$)') AND param = '*testing.B' THEN 'benchmark' END AS lens FROM f WHERE file LIKE '%\\_test.go' ESCAPE '\\') WHERE lens IS NOT NULL GROUP BY ALL
UNION ALL SELECT file, 'generate', min(line), 1 FROM f WHERE p_type = 'SMALL' GROUP BY file UNION ALL SELECT file, 'regenerate_cgo', max(line), 1 FROM f WHERE p_type = 'LARGE' GROUP BY file""")
def code_lenses(spark, sf):
    """Tests and benchmarks of test files, the first generate directive and the last import of C of each file."""
    name = F.when(F.col("p_type") == "STANDARD", F.concat(F.lit("Test"), "p_name")).when(F.col("p_type") == "ECONOMY", "Testing").when(F.col("p_type") == "MEDIUM", "Benchmark").when(F.col("p_type") == "PROMO", "Test").otherwise(F.col("p_name"))
    text = F.when(F.col("p_type") == "SMALL", "//go:generate x").when(F.col("p_type") == "LARGE", 'import "C"').otherwise("")
    f = table(spark, sf, "part").select(F.concat(F.lit("f"), "p_size", F.when(F.col("p_size") % 3 == 0, "_test.go").otherwise(".go")).alias("file"), F.col("p_partkey").alias("line"), name.alias("name"), F.when(F.col("p_type") == "MEDIUM", "*testing.B").otherwise("*testing.T").alias("param"), text.alias("text"))
    tests = D.test_lenses(f).groupBy("file", "lens").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    return tests.unionByName(D.file_lenses(f).select("file", "lens", F.col("line").alias("first"), F.lit(1).cast("long").alias("n")))


@query("SELECT file, string_agg(DISTINCT brand, ',' ORDER BY brand) AS organized FROM (SELECT l_orderkey AS file, p_brand AS brand, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY file HAVING list(brand ORDER BY brand) IS DISTINCT FROM list(DISTINCT brand ORDER BY brand) OR max(n) < 0 OR file IN (SELECT l_orderkey FROM (SELECT l_orderkey, p_brand, lag(p_brand) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE b >= p_brand)")
def organize_imports(spark, sf):
    """Imports of each order's file, in the order of its lines, put right by one edit, and the edit applied."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    before = l.groupBy(F.col("l_orderkey").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand"))), lambda x: x["p_brand"]).alias("before"))
    e = D.organized(before)
    done = F.concat(F.slice("before", F.lit(1), F.col("start")), "put", F.slice("before", F.col("stop") + 1, F.size("before")))
    return e.select("file", F.array_join(done, ",").alias("organized"))


@query(LX + """, a AS (SELECT doc_id, min({'line': line, 'col': col, 'token': token}).token AS name FROM tok GROUP BY doc_id), c AS (SELECT l.doc_id, l.line, a.name, string_split_regex(CASE WHEN l.line % 7 = 0 THEN '//go:x ' || l.text ELSE l.text END, '\\b' || a.name || '\\b') AS g FROM lines l JOIN a ON a.doc_id = l.doc_id WHERE l.line % 7 <> 0),
p AS (SELECT doc_id, line, name, unnest(range(1, len(g))) AS k, g FROM c WHERE len(g) > 1)
SELECT doc_id, line, CAST(1 + list_sum(list_transform(g[1:k], lambda x: strlen(x))) + (k - 1) * strlen(name) AS BIGINT) AS col, CAST(1 + list_sum(list_transform(g[1:k], lambda x: strlen(x))) + k * strlen(name) AS BIGINT) AS end_col FROM p""")
def doc_comment_edits(spark, sf):
    """Each document's first name, renamed in the prose lines of its own comment; every seventh line is a directive."""
    x = Lexical(spark, sf)
    asked = x.tokens.groupBy("doc_id").agg(F.min(F.struct("line", "col", "token"))["token"].alias("name")).select(F.col("doc_id").alias("owner"), "name", F.lit("renamed").alias("new_text"))
    text = F.when(F.col("line") % 7 == 0, F.concat(F.lit("//go:x "), "text")).otherwise(F.col("text"))
    comments = x.lines().select(F.col("doc_id").alias("owner"), "line", text.alias("text"))
    e = D.comment_edits(comments, asked, X.is_directive)
    return e.select(F.col("owner").alias("doc_id"), "line", "col", "end_col")


@query("SELECT doc_id, CASE WHEN length(text) >= 6 THEN 'Z' || substr(text, 3, 3) || '!' || substr(text, 7) ELSE 'all' END AS text FROM documents")
def content_changes(spark, sf):
    """Changes of a text, each against what the one before it made; short texts get a new one whole."""
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(t).alias("text"))
    n = F.length("text")
    long = F.array(edit(F.lit(0), F.lit(2), "Z"), edit(F.lit(4), F.lit(5), "!"))
    edits = F.when(n >= 6, long).otherwise(F.array(edit(F.lit(0), n, "all")))
    return table(spark, sf, "documents").select("doc_id", X.apply_changes(F.col("text"), edits).alias("text"))


@query("SELECT o_orderkey, greatest(40000, CAST(floor(o_totalprice / 2) AS BIGINT)) AS mem FROM orders")
def memory_limits(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.memory_limit(F.floor("o_totalprice"), 0.5, 40000).alias("mem"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END AS name FROM part")
def fallback_names(spark, sf):
    """Names for packages that aren't loaded: the last segment that isn't a version."""
    path = F.concat(F.lit("example.com/"), "p_brand", F.lit("/"), "p_name", F.when(F.col("p_size") % 3 == 0, "/v2").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, X.generic_name(path)).otherwise(X.assumed_name(path)).alias("name"))


@query(LX + """, q AS (SELECT p.doc_id, p.line, p.q_col, p.unit, o.token, o.unit AS own, d.unit AS d_unit, o.is_decl FROM (SELECT pos.*, l.unit FROM pos JOIN lines l ON l.doc_id = pos.doc_id AND l.line = pos.line) p JOIN occ o ON o.doc_id = p.doc_id AND o.line = p.line AND o.col <= p.q_col AND p.q_col < o.end_col JOIN (SELECT doc_id, source AS unit FROM documents) d ON d.doc_id = o.d_doc)
SELECT doc_id, line, q_col, token AS answer, CASE WHEN token IN ('the', 'and', 'of', 'de', 'la') THEN 'builtin' WHEN token IN (SELECT source FROM documents) THEN 'package' WHEN d_unit = unit THEN 'same package' ELSE 'dependency' END AS tier FROM q""")
def definition_chain(spark, sf):
    """Where a definition is sought when the index has none: builtins, package names, the same package, a dependency."""
    x = Lexical(spark, sf)
    keys = ["doc_id", "line", "q_col"]
    hit = L.resolve_at(x.positions(), x.occurrences_near(x.positions()).select("doc_id", "line", "col", "end_col", "is_decl", "token", "unit", "d_doc"), "token", "unit", "d_doc")
    hit = hit.join(x.docs.select(F.col("doc_id").alias("d_doc"), F.col("source").alias("d_unit")), "d_doc").withColumn("answer", F.col("token"))
    packages = x.docs.select(F.col("source").alias("token")).distinct()
    tiers = [("builtin", hit.where(F.col("token").isin("the", "and", "of", "de", "la"))), ("package", hit.join(packages, "token", "left_semi")), ("same package", hit.where("d_unit = unit")), ("dependency", hit.where("d_unit != unit"))]
    return L.chain(hit, keys, tiers)


# stores


@query("SELECT sha256(text) AS key, CAST(strlen(text) AS BIGINT) AS bytes, true AS sound, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def cas_roundtrip(spark, sf):
    """Texts put into a content-addressed store, twice, and got back: once each, with sound keys."""
    path, d = _scratch(spark, "cas"), table(spark, sf, "documents").where("text IS NOT NULL").select(F.encode("text", "UTF-8").alias("blob"))
    store.put(d, path)
    store.put(d, path)
    keys = d.select(store.blob_key(F.col("blob")).alias("key"))
    got = store.get(keys, path).groupBy("key").agg(F.max(F.octet_length("blob")).cast("long").alias("bytes"), F.bool_and("sound").alias("sound"), F.count("*").alias("copies"))
    return got.where("copies = 1").join(keys.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "bytes", "sound", "n")


@query("SELECT sha256(p_name || p_size) AS key, p_size > 25 AS there FROM (SELECT DISTINCT p_name, p_size FROM part)")
def cas_has(spark, sf):
    """Which of the asked keys are stored: those of the larger parts."""
    p, path = table(spark, sf, "part").select("p_size", F.encode(F.concat("p_name", "p_size"), "UTF-8").alias("blob")), _scratch(spark, "cas")
    store.put(p.where("p_size > 25").select("blob"), path)
    return store.has(p.select(store.blob_key(F.col("blob")).alias("key")).distinct(), path)


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def compacted(spark, sf):
    """A table of many small files rewritten into few."""
    path, to = _scratch(spark, "many"), _scratch(spark, "few")
    table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).repartition(24).write.parquet(path)
    return store.compact(spark, path, to, 2)


@query("SELECT p_brand AS key, 'new ' || max(p_size) FILTER (p_size > 45) AS value FROM part GROUP BY 1 HAVING max(p_size) > 45 UNION ALL SELECT p_brand, 'old ' || max(p_size) FROM part GROUP BY 1 HAVING max(p_size) <= 45")
def metadata(spark, sf):
    """Values put twice under some keys: the last one counts."""
    p, path = table(spark, sf, "part"), _scratch(spark, "meta")
    value = lambda word, df: df.groupBy(F.col("p_brand").alias("key")).agg(F.concat(F.lit(f"{word} "), F.max("p_size")).alias("value"))
    store.put_meta(value("old", p), path, 1)
    store.put_meta(value("new", p.where("p_size > 45")), path, 2)
    return store.get_meta(spark, path)


@query("SELECT * FROM (VALUES (1, 'created'), (2, 'opened'), (3, 'recreated'), (4, 'opened')) AS v(step, state)")
def store_versions(spark, sf):
    """A store is created, opened, and built anew where another version wrote it."""
    path = _scratch(spark, "store")
    return spark.createDataFrame([(k, store.open_store(spark, path, v)) for k, v in enumerate((4, 4, 5, 5), 1)], "step int, state string")


_POINTERS = "WITH mine AS (SELECT s_suppkey AS unit, CAST(s_nationkey AS VARCHAR) AS key, 'go1' AS toolchain FROM supplier WHERE s_acctbal >= 5000), other AS (SELECT s_suppkey AS unit, s_name AS key, CASE WHEN s_acctbal < 0 THEN 'go0' ELSE 'go1' END AS toolchain FROM supplier) "


def _pointers(spark, sf):
    s = table(spark, sf, "supplier")
    mine = s.where("s_acctbal >= 5000").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").cast("string").alias("key"), F.lit("go1").alias("toolchain"))
    return mine, s.select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("key"), F.when(F.col("s_acctbal") < 0, "go0").otherwise("go1").alias("toolchain"))


@query(_POINTERS + "SELECT unit, key, false AS seeded FROM mine UNION ALL SELECT unit, key, true FROM other WHERE toolchain = 'go1' AND unit NOT IN (SELECT unit FROM mine)")
def seeded_units(spark, sf):
    """Pointers that a new workspace takes from another one of the same toolchain."""
    return store.seeded(*_pointers(spark, sf), F.lit("go1")).select("unit", "key", "seeded")


@query(_POINTERS + "SELECT unit, key FROM mine UNION ALL SELECT unit, key FROM other WHERE unit NOT IN (SELECT unit FROM mine)")
def pointer_upsert(spark, sf):
    mine, other = _pointers(spark, sf)
    return store.upsert_pointers(other, mine).select("unit", "key")


@query(R + "SELECT pkg_hash AS unit, row_number() OVER (PARTITION BY pkg_hash ORDER BY file, line, col, id_hash) - 1 AS seq, id_hash AS id, name, kind, file, line, col FROM sym")
def unit_blobs(spark, sf):
    """Units' facts encoded into one blob each, and decoded again in order."""
    return store.decode_units(_blobs(spark, sf))


def _blobs(spark, sf):
    s = Relational(spark, sf).symbols()
    return store.encode_units(s.select(F.col("pkg_hash").alias("unit"), F.col("id_hash").alias("id"), "name", "kind", "file", "line", "col"))


@query(R + "SELECT pkg_hash AS unit, id_hash AS id, name, kind FROM sym")
def unit_names(spark, sf):
    """Only the names and kinds of the encoded units."""
    return store.decode_names(_blobs(spark, sf))


# incremental maintenance

_KEYS = ", ck AS (SELECT unit, is_new, sha256(string_agg(CAST(file AS VARCHAR), ',' ORDER BY CAST(file AS VARCHAR))) AS key FROM snap GROUP BY ALL) "


@query(R + _KEYS + "SELECT unit, key FROM ck WHERE is_new AND key IN (SELECT key FROM ck WHERE NOT is_new)")
def cas_hits(spark, sf):
    """Units whose result is stored already, whoever built it."""
    r = Relational(spark, sf)
    return C.reusable(C.content_keys(r.snapshot(True)), C.content_keys(r.snapshot(False)))


@query(R + _KEYS + "SELECT n.unit, CASE WHEN s.s_acctbal >= 0 AND o.key IS NOT NULL THEN o.key ELSE n.key END AS own, coalesce(s.s_acctbal >= 0 AND o.key IS NOT NULL, false) AS trusted FROM (SELECT * FROM ck WHERE is_new) n LEFT JOIN (SELECT * FROM ck WHERE NOT is_new) o USING (unit) LEFT JOIN supplier s ON s.s_suppkey = n.unit")
def stat_shortcut(spark, sf):
    """Content hashes of units whose stats are equal (suppliers that owe nothing) are taken on trust."""
    r = Relational(spark, sf)
    hashed = C.content_keys(r.snapshot(True)).withColumnRenamed("key", "own")
    stored = C.content_keys(r.snapshot(False)).withColumnRenamed("key", "own").join(hashed.select("unit"), "unit", "left_semi")
    equal = r.supplier.select(F.col("s_suppkey").alias("unit"), (F.col("s_acctbal") >= 0).alias("same"))
    return C.own_hashes(stored, equal, hashed)


@query("SELECT o_orderkey AS key, o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAYS AS swept FROM orders")
def gc_aged(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("mtime"))
    return C.aged(o, F.lit("1998-01-01").cast("timestamp_ntz")).select("key", "swept")


@query("SELECT s_nationkey AS store, bool_or(s_acctbal < 0) AS deferred FROM supplier GROUP BY s_nationkey")
def gc_deferred(spark, sf):
    """Stores that one of those who share them can't be read for aren't swept."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("store"), (F.col("s_acctbal") >= 0).alias("readable"))
    return s.groupBy("store").agg(C.deferred(s).alias("deferred"))


@query("SELECT CAST((seq - 1) // 50 AS BIGINT) AS batch, count(*) AS n, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS lost FROM (SELECT c_custkey + 1 AS seq, c_acctbal >= 0 AS ok FROM customer) GROUP BY 1")
def commit_batches(spark, sf):
    return C.batches_of(table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("seq"), (F.col("c_acctbal") >= 0).alias("ok")))


@query("SELECT user_id, event_id AS entry, CAST(sum(size) OVER w AS BIGINT) AS running, pinned OR sum(size) OVER w <= 500 AS kept FROM (SELECT *, CAST(floor(value) AS BIGINT) AS size, event_type = 'signup' AND event_id % 4 = 0 AS pinned FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY pinned DESC, ts DESC, event_id ROWS UNBOUNDED PRECEDING)")
def pinned_budget(spark, sf):
    """A cache in which pinned entries stay even beyond the limit."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("entry"), F.col("ts").alias("last_used"), F.floor("value").alias("size"), ((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0)).alias("pinned"))
    return C.budget(e, ["user_id"], 500).select("user_id", "entry", "running", "kept")


# synchronisation

_DOC = "WITH d AS (SELECT user_id AS uri, event_id AS gen, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' WHEN 'error' THEN 'save' ELSE 'change' END AS kind, event_type || event_id AS text FROM events) "


def _document_events(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "error", "save").otherwise("change")
    return table(spark, sf, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("gen"), kind.alias("kind"), F.concat("event_type", "event_id").alias("text"))


@query(_DOC + """, l AS (SELECT *, sum(CASE WHEN kind IN ('open', 'close') THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY gen ROWS UNBOUNDED PRECEDING) AS life FROM d),
s AS (SELECT *, bool_or(kind = 'open') OVER w AS is_open, sum(CASE WHEN kind IN ('open', 'change') THEN 1 ELSE 0 END) OVER w AS v, max(CASE WHEN kind IN ('open', 'change') THEN gen END) OVER w AS at FROM l WINDOW w AS (PARTITION BY uri, life ORDER BY gen ROWS UNBOUNDED PRECEDING))
SELECT s.uri, s.gen, CASE WHEN is_open THEN t.text END AS text, CASE WHEN is_open THEN CAST(v AS BIGINT) END AS version, is_open AND s.kind = 'save' AS reindex FROM s LEFT JOIN d t ON t.uri = s.uri AND t.gen = s.at""")
def document_sync(spark, sf):
    """The text that a document has after each notification, and which saves ask for a new index."""
    return T.document_state(_document_events(spark, sf)).select("uri", "gen", "text", "version", "reindex")


@query(_DOC + "SELECT uri, gen, row_number() OVER (PARTITION BY uri ORDER BY gen) - 1 AS waits_for FROM d")
def ordered_queue(spark, sf):
    """How many notifications of a document each one waits for."""
    return T.in_order(_document_events(spark, sf), "uri", "gen").select("uri", "gen", F.col("waits_for").cast("long").alias("waits_for"))


@query(_DOC + ", e AS (SELECT uri, max(gen) AS gen, arg_max(kind, gen) AS kind FROM d WHERE gen < 5000 AND kind IN ('open', 'close') GROUP BY uri) SELECT uri, gen FROM e WHERE kind = 'open'")
def pending_opens(spark, sf):
    """Documents that are open when the workspace gets ready, after event 5000."""
    return T.pending_opens(_document_events(spark, sf), F.lit(5000))


@query(_E + "SELECT gen, CAST(regexp_extract(line, 'processed=([0-9]+)', 1) AS BIGINT) AS processed, CAST(regexp_extract(line, 'errors=([0-9]+)', 1) AS BIGINT) AS errors FROM (SELECT gen, 'STATS processed=' || size || ' errors=' || path AS line FROM e)")
def stats_lines(spark, sf):
    """The last line of a build's protocol."""
    e = changes(spark, sf).select("gen", F.concat(F.lit("STATS processed="), "size", F.lit(" errors="), "path").alias("line"))
    number = lambda name: F.regexp_extract("line", rf"{name}=([0-9]+)", 1).cast("long").alias(name)
    return e.select("gen", number("processed"), number("errors"))


# smaller ones


@query(LX + "SELECT p.doc_id, p.line, regexp_extract(substr(l.text, 1, CAST(p.q_col AS INTEGER)), '[\\p{L}\\p{Nd}_]*$') AS ident FROM pos p JOIN lines l ON l.doc_id = p.doc_id AND l.line = p.line")
def ident_before(spark, sf):
    """The identifier that ends at a position of each line, which a completion has for its prefix."""
    x = Lexical(spark, sf)
    at = x.positions().join(x.lines(), ["doc_id", "line"])
    return at.select("doc_id", "line", X.ident_before(F.substring("text", F.lit(1), F.col("q_col").cast("int"))).alias("ident"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN least(k, 1) ELSE k END AS argument FROM (SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 2 ELSE 3 END AS k FROM part)")
def signature_help(spark, sf):
    """The argument that a position is in, of three that end at 10, 20 and 30; calls of even number are variadic with two."""
    ends = F.array(*[F.lit(k) for k in (10, 20, 30)])
    return table(spark, sf, "part").select("p_partkey", X.active_argument(ends, F.col("p_size"), F.lit(2), F.col("p_partkey") % 2 == 0).alias("argument"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 64 THEN text ELSE '[truncated]' || chr(10) || right(text, CAST(list_max(list_filter(range(0, 65), lambda k: strlen(right(text, CAST(k AS INTEGER))) <= 64)) AS INTEGER)) END AS tail FROM documents WHERE text IS NOT NULL")
def log_tail(spark, sf):
    """The last 64 bytes of each text, in whole characters."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.tail(F.col("text"), 64).alias("tail"))


@query("SELECT p_partkey, p_type, p_size + CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 1000 ELSE 0 END AS size FROM part WHERE p_type NOT IN ('SMALL', 'PROMO') OR p_size > 20")
def partition_replace(spark, sf):
    """Partitions of two kinds are written again with other rows; the others stay."""
    from refloom.sources.files import replace_partitions

    path, p = _scratch(spark, "kinds"), table(spark, sf, "part").select("p_partkey", "p_type", F.col("p_size").alias("size"))
    replace_partitions(p, path, "p_type")
    replace_partitions(p.where("p_type IN ('SMALL', 'PROMO') AND size > 20").withColumn("size", F.col("size") + 1000), path, "p_type")
    return spark.read.parquet(path).select("p_partkey", "p_type", "size")


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS price FROM orders")
def row_replace(spark, sf):
    """Rows of some keys are replaced by new ones."""
    from refloom.sources.files import replace_rows

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return replace_rows(o, o.where("status = 'F'").withColumn("price", -F.col("price")), ["o_orderkey"])


@query("SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN 'edited ' || r_name ELSE r_name END AS text FROM region")
def overlay_sources(spark, sf):
    """Files in a folder, some of which an editor holds in a newer version."""
    from refloom.sources.files import listing, texts

    path, r = _scratch(spark, "sources"), table(spark, sf, "region").select("r_regionkey", "r_name")
    r.select(F.concat("r_regionkey", F.lit(" "), "r_name").alias("value"), F.col("r_regionkey").alias("k")).repartition("k").write.partitionBy("k").text(path)
    number = F.regexp_extract("path", "k=([0-9]+)", 1).cast("int")
    names = listing(spark, path, ".txt").select("path", number.alias("k"))
    edited = names.join(r, F.col("k") == F.col("r_regionkey")).where("k % 2 = 0")
    both = edited.select(F.col("path").alias("uri"), F.lit(1).alias("version"), F.lit("old").alias("text")).unionAll(edited.select("path", F.lit(2), F.concat("k", F.lit(" edited "), "r_name")))
    t = texts(spark, path, both, ".txt")
    return t.select(F.split("text", " ")[0].cast("int").alias("k"), F.regexp_replace(F.rtrim(F.translate("text", "\n", "")), r"^[0-9]+ ", "").alias("text"))


@query("""WITH v AS (SELECT p_size AS file, p_partkey AS line, p_partkey % 40 AS col, CASE WHEN p_size % 10 = 0 THEN '_' ELSE p_name END AS name, p_brand AS type, CASE p_type WHEN 'STANDARD' THEN 'assignVariableTypes' WHEN 'ECONOMY' THEN 'rangeVariableTypes' WHEN 'MEDIUM' THEN 'constantValues' END AS kind FROM part),
a AS (SELECT l_orderkey % 50 + 1 AS file, l_orderkey AS line, CAST(l_quantity AS BIGINT) AS col, l_linenumber - 1 AS place, p_name AS param FROM lineitem JOIN part ON p_partkey = l_partkey),
e AS (SELECT DISTINCT p_size AS file, k.kind FROM part, (VALUES ('assignVariableTypes', 2), ('rangeVariableTypes', 3), ('constantValues', 4), ('parameterNames', 5)) AS k(kind, n) WHERE p_size % n <> 0)
SELECT x.* FROM (SELECT file, line, col, kind, (CASE WHEN kind = 'constantValues' THEN '= ' ELSE ': ' END) || type AS label FROM v WHERE name <> '_' AND kind IS NOT NULL UNION ALL SELECT file, line, col, 'parameterNames', param || ':' FROM a WHERE place < 3) x JOIN e ON e.file = x.file AND e.kind = x.kind""")
def inlay_hints(spark, sf):
    """Types of variables, values of constants and names of parameters, of the kinds that are enabled for a file."""
    p = table(spark, sf, "part")
    how = F.when(F.col("p_type") == "STANDARD", "assign").when(F.col("p_type") == "ECONOMY", "range").when(F.col("p_type") == "MEDIUM", "const")
    variables = p.select(F.col("p_size").cast("long").alias("file"), F.col("p_partkey").alias("line"), (F.col("p_partkey") % 40).alias("end_col"), F.when(F.col("p_size") % 10 == 0, "_").otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("type"), how.alias("how"))
    l = table(spark, sf, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    arguments = l.select((F.col("l_orderkey") % 50 + 1).alias("file"), F.col("l_orderkey").alias("line"), F.col("l_quantity").cast("long").alias("col"), (F.col("l_linenumber") - 1).alias("place"), F.col("p_name").alias("param"), F.lit(3).alias("params"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in (("assignVariableTypes", 2), ("rangeVariableTypes", 3), ("constantValues", 4), ("parameterNames", 5))])
    enabled = p.select(F.col("p_size").cast("long").alias("file"), F.explode(kinds).alias("k")).where("file % k.n != 0").select("file", "k.kind")
    return D.inlay_hints(variables, arguments, enabled)


@query("SELECT p_partkey, p_size % 4 IN (0, 3) AS source, p_size % 4 = 3 AS test FROM part")
def file_candidates(spark, sf):
    """Which files of a folder are sources of its package, and which of those are tests."""
    name = F.when(F.col("p_size") % 4 == 0, "a.go").when(F.col("p_size") % 4 == 1, "_a.go").when(F.col("p_size") % 4 == 2, ".a_test.go").otherwise("a_test.go")
    path = F.concat(F.lit("/w/"), "p_brand", F.lit("/"), name)
    return table(spark, sf, "part").select("p_partkey", X.source_file(path).alias("source"), X.test_file(path).alias("test"))
