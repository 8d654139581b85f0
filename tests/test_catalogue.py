import pytest
from conftest import same_rows

from refloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_postings_are_exactly_the_occurrences(spark, sf):
    from refloom.operators import postings as P
    from refloom.sources.tables import Relational

    r = Relational(spark, sf).postings()
    built = P.build(r).selectExpr("target_pkg", "target_id", "src", "inline(locations)")
    cols = ["target_pkg", "target_id", "src", *P.LOCATION]
    assert built.select(cols).exceptAll(r.select(cols)).count() == 0 == r.select(cols).exceptAll(built.select(cols)).count()


def test_line_diff_is_shortest_and_gives_the_other_text(spark, sf):
    import random

    from refloom.operators.documents import diff_lines, line_edits, lines_of

    def common(a, b):  # the longest common subsequence, by the plain table
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(1)
    some = lambda: "\n".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 12))) + r.choice(["", "\n"])
    texts = [x[0] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    fixed = [("", "a\nb"), ("a\nb\n", ""), ("a\nb\nc\n", "a\nx\nc\n"), ("a\na\n", "a\n"), ("", ""), ("a\rb\fc", "a\rb\u2028c"), ("x\r\ny", "x\ny")]
    for a, b in [*zip(texts, texts[1:]), *fixed, *((some(), some()) for _ in range(1500))]:
        lines, out, at, cost = lines_of(a), [], 0, 0
        assert "".join(lines) == a
        for start, stop, new in line_edits(a, b):
            assert at <= start <= stop
            out += [*lines[at:start], new]
            cost += stop - start + len(lines_of(new))
            at = stop
        assert "".join([*out, *lines[at:]]) == b
        if len(lines) < 60:
            assert cost == len(lines) + len(lines_of(b)) - 2 * common(lines, lines_of(b))
    d = spark.createDataFrame([(1, "aé\nb\n", "aé\nc\n")], "id long, before string, after string")
    assert [tuple(e) for e in diff_lines(d).collect()] == [(1, 1, 2, 4, 6, "c\n")]
    assert not line_edits("x\n" * 3000 + "y", "x\n" * 3000 + "y") and len(line_edits("\n".join(f"a{k}" for k in range(1500)), "\n".join(f"b{k}" for k in range(1500)))) == 1


def test_method_relations_of_all_orders_equal_brute_force(spark, sf, duck):
    used = duck.sql("SELECT l_orderkey, l_suppkey, p_brand, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END FROM lineitem JOIN part ON p_partkey = l_partkey").fetchall()
    req, own = {}, {}
    for o, s, name, fp in used:
        req.setdefault(o, set()).add((name, fp))
        own.setdefault(s, set()).add((name, fp))
    names = {o: {n for n, _ in q} for o, q in req.items()}
    has = {s: {n for n, _ in e} for s, e in own.items()}
    sound = {o: q for o, q in req.items() if all(fp for _, fp in q)}
    ok = {(o, s) for o, q in sound.items() for s, e in own.items() if q <= e}
    emb = {(b, a) for a, q in sound.items() for b, p in req.items() if a != b and q <= p}
    good = {s for (s,) in duck.sql("SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0").fetchall()}
    sub = {(o, s, False) for o, s in ok} | {(a, b, True) for b, a in emb}
    got = lambda name, *cols: sorted(tuple(r) for r in QUERIES[name](spark, sf).select(*cols).collect())
    assert any(o % 50 for o, _ in ok)
    assert got("method_entries", "type_id", "name", "fp") == sorted((s, n, f) for s in good & set(own) for n, f in own[s])
    assert got("candidates_all", "iface", "type_id") == sorted((o, s) for o in req for s in own if names[o] <= has[s])
    assert got("candidates_any", "iface", "type_id") == sorted((o, s) for o in req for s in own if names[o] & has[s])
    assert got("implementers", "iface", "type_id") == sorted(ok)
    assert got("supertypes", "sub", "sup") == sorted(emb)
    assert got("subtypes", "sup", "sub", "is_interface") == sorted(sub)
    place, want = {}, []
    for sup, b, is_interface in sorted(sub, key=lambda x: (x[0], x[2], x[1])):
        place[sup] = place.get(sup, 0) + 1
        want.append((sup, b, is_interface, place[sup]))
    assert got("type_hierarchy_order", "sup", "sub", "is_interface", "place") == sorted(want)
    per = {s: [o for o, t in ok if t == s] for _, s in ok}
    assert got("satisfied_interfaces", "type_id", "n", "least", "most") == sorted((s, len(x), min(x), max(x)) for s, x in per.items())
    assert got("method_implementations", "iface", "type_id", "name", "fp") == sorted((o, s, n, f) for o, s in ok for n, f in req[o])
    assert got("method_interfaces", "iface", "name", "type_id") == sorted({(o, n, s) for o, s in ok for n, _ in req[o]})


def test_closures_and_changes_of_the_whole_table_equal_brute_force(spark, sf, duck):
    from refloom.sources.tables import SPLIT_DAY

    parts = dict(duck.sql("SELECT p_partkey, p_size FROM part").fetchall())
    prod = {(p, d) for p in parts for d in (p // 2, p // 3) if d and d in parts}
    every = prod | {(p, p + 1) for p in parts if p % 97 == 0 and p + 1 in parts}
    users, level = {p: [s for s, d in every if d == p] for p in parts}, {}
    for p in sorted(parts):
        level[p] = max((level[d] + 1 for s, d in prod if s == p), default=0)

    def reach(seeds, through):
        seen, todo = set(seeds), list(seeds)
        while todo:
            n = todo.pop()
            new = [u for u in users[n] if u not in seen] if n in through else []
            seen |= set(new)
            todo += new
        return seen

    got = lambda name, *cols: sorted(tuple(r) for r in QUERIES[name](spark, sf).select(*cols).collect())
    closure = {p: reach([p], parts) for p in parts}
    assert got("closure", "seed", "node") == sorted((p, n) for p, c in closure.items() for n in c)
    order = {p: sorted(c - {p}, key=lambda n: (level[n], n)) for p, c in closure.items()}
    assert got("ordered_closure", "seed", "node", "place") == sorted((p, n, k) for p, c in order.items() for k, n in enumerate(c, 1))
    old, new = {}, {}
    for u, f, late in duck.sql(f"SELECT DISTINCT l_suppkey, l_partkey, l_shipdate >= TIMESTAMP '{SPLIT_DAY}' FROM lineitem").fetchall():
        (new if late else old).setdefault(u, set()).add(f)
    changed = {u for u in old.keys() | new.keys() if old.get(u) != new.get(u)}
    assert got("cache_invalidate", "unit") == sorted((u,) for u in new if u not in changed and not (old.get(u, set()) | new[u]) & changed)


def test_reindex_stops_where_exports_stay(spark):
    from refloom.operators import incremental as C

    units = lambda own, export: spark.createDataFrame([(n, own.get(n, "o"), export.get(n, "e")) for n in range(6)], "node long, own string, export string")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 0), (5, 4), (5, 3)], "src long, dst long")
    levels = spark.createDataFrame([(0, 0), (1, 1), (4, 1), (2, 2), (3, 3), (5, 4)], "node long, level long")
    named = spark.createDataFrame([(0,), (2,)], "node long")
    redo = lambda own, export: sorted(r.node for r in C.reindex(named, units({}, {}), units(own, export), edges, levels).collect())
    assert redo({}, {}) == []  # nothing differs
    assert redo({0: "new"}, {}) == [0]  # the body alone
    assert redo({0: "new"}, {0: "f"}) == [0, 1, 4]  # its users are built, their exports stay
    assert redo({0: "new"}, {0: "f", 4: "f"}) == [0, 1, 4, 5]
    assert redo({0: "new", 2: "new"}, {0: "f", 1: "f", 2: "f", 3: "f", 4: "f"}) == [0, 1, 2, 3, 4, 5]
    assert redo({3: "new"}, {3: "f"}) == []  # a change that nobody named
    a = {r.node: r.key for r in C.unit_keys(units({}, {}), edges).collect()}
    b = {r.node: r.key for r in C.unit_keys(units({}, {1: "f"}), edges).collect()}
    assert {n for n in a if a[n] != b[n]} == {2}  # a dependency's export is in the key


def test_repeated_entries_are_confirmed_once(spark):
    from refloom.operators import relations as M

    req = spark.createDataFrame([(100, "A", 5), (100, "B", 6), (101, "A", 0), (102, "A", 5), (102, "A", 5)], "iface long, name string, fp long")
    own = spark.createDataFrame([(1, "A", 5), (1, "A", 5), (1, "B", 6), (2, "A", 5), (2, "B", 7), (3, "A", 0)], "type_id long, name string, fp long")
    assert sorted(tuple(r) for r in M.confirmed(req, own).collect()) == [(100, 1), (102, 1), (102, 2)]
    many = spark.range(5000).selectExpr("id AS type_id", "'A' AS name", "5L AS fp")
    assert M.confirmed(req, many).count() == 5000
    big = spark.range(80).selectExpr("500L AS iface", "concat('N', id) AS name", "id + 1 AS fp")
    two = spark.createDataFrame([(501, "N3", 4), (501, "N70", 71), (502, "N3", 4), (503, "N3", 5), (503, "N4", 5)], "iface long, name string, fp long")
    assert sorted(tuple(r) for r in M.embedding(big.unionAll(two)).collect()) == [(501, 500), (502, 500), (502, 501)]


def test_corresponding_and_either(spark):
    from refloom.operators import relations as M

    req = spark.createDataFrame([(100, "A", 5), (101, "A", 5), (101, "B", 6)], "iface long, name string, fp long")
    own = spark.createDataFrame([(1, "A", 5), (2, "A", 5), (2, "B", 6), (3, "B", 6)], "type_id long, name string, fp long")
    asked = spark.createDataFrame([(7, 2, "A"), (8, 101, "B"), (9, 3, "B")], "query_id long, type_id long, name string")
    assert sorted(tuple(r) for r in M.corresponding(asked, req, own).collect()) == [(7, 1, "A"), (7, 100, "A"), (7, 101, "A"), (8, 2, "B")]
    assert sorted(tuple(r) for r in M.candidates_either(req, own).collect()) == [(100, 1, False), (100, 2, False), (100, 101, True), (101, 2, False)]


@pytest.mark.parametrize("sent", [None, 0])
def test_embedding_of_odd_sets_equals_brute_force(spark, monkeypatch, sent):
    import random

    from refloom.operators import relations as M

    if sent is not None:
        monkeypatch.setattr(M, "SENT", sent)  # nothing but filters is sent
    r = random.Random(7)
    pool = [(f"N{k % 40}", k // 40 + 1) for k in range(120)]
    sets = [set(r.sample(pool[: r.choice([4, 9, 120])], r.choice([1, 1, 2, 2, 3, 4]))) for _ in range(150)]
    sets += [set(r.sample(pool, r.choice([20, 24, 25, 30, 64, 65, 90]))) for _ in range(20)]
    sets += [set(r.sample(sorted(s), r.randint(1, min(len(s), 30)))) for s in sets[150:] for _ in range(6)]
    sets += [s | {r.choice([("Z", 0), (None, 3), ("Z", None), (None, None)])} for s in sets[::9]] + [{("Z", 0)}, {(None, 3)}, *([sets[0]] * 130)]
    rows = [(i - 200, n, fp) for i, s in enumerate(sets) for n, fp in s]
    r.shuffle(rows)
    req = spark.createDataFrame([*rows, *rows[:300], (None, "N1", 1)], "iface long, name string, fp long")
    live = [{(n, fp) for n, fp in s if n is not None and fp} for s in sets]
    want = sorted((a - 200, b - 200) for a, s in enumerate(live) if len(s) == len(sets[a]) for b, t in enumerate(live) if a != b and s <= t)
    assert len(want) > 20000
    assert sorted(tuple(x) for x in M.embedding(req).collect()) == want
    assert sorted(tuple(x) for x in M.embedding(req, 10).collect()) == want
