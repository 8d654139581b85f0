"""Graph operators over edges (src imports dst): closures, levels, orders, keys.

Loops keep a frontier, write each round to the shared folder and stop when it is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.sources.scratch import discard, materialize

ROUNDS = 10_000


def reverse_deps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, importers): direct importers over both kinds of edge, sorted."""
    e = edges.select(F.col("dst").alias("node"), "src").distinct().join(nodes.select("node"), "node", "left_semi")
    return e.groupBy("node").agg(F.sort_array(F.collect_list("src")).alias("importers"))


def closure(seeds: DataFrame, edges: DataFrame, compact: int = 8) -> DataFrame:
    """(seed, node): each seed with all its transitive importers; cycles are fine. What has been seen is one table and
    the rounds since; every `compact` rounds they become one table again, so neither plans nor files grow with the depth."""
    back = materialize(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct(), "edges")
    seen = frontier = materialize(seeds.select("seed", F.col("seed").alias("node")).distinct(), "seen")
    parts = [seen]
    for n in range(1, ROUNDS):
        frontier = materialize(frontier.join(back, "node").select("seed", F.col("next").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti"), "frontier")
        if not frontier.limit(1).count():
            discard(back, frontier)
            return seen
        parts.append(frontier)
        seen = seen.unionByName(frontier)
        if n % compact == 0:
            seen, old = materialize(seen, "seen"), parts[:-1]
            parts = [seen, frontier]
            discard(*old)
    raise RuntimeError("no end of the closure")


def levels(nodes: DataFrame, edges: DataFrame, compact: int = 8) -> DataFrame:
    """(node, level): length of the longest path to a node without dependencies; edges must be acyclic. A
    node's level is the last round in which the frontier meets it."""
    deps = materialize(edges.select("src", "dst").distinct(), "edges")
    frontier = materialize(nodes.select("node").join(deps.select(F.col("src").alias("node")), "node", "left_anti"), "frontier")
    met, parts = frontier.withColumn("level", F.lit(0).cast("long")), [frontier]
    top = lambda m: m.groupBy("node").agg(F.max("level").alias("level"))
    for n in range(1, ROUNDS):
        frontier = materialize(deps.join(frontier.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct(), "frontier")
        if not frontier.limit(1).count():
            discard(deps, frontier)
            return top(met)
        parts.append(frontier)
        met = met.unionByName(frontier.withColumn("level", F.lit(n).cast("long")))
        if n % compact == 0:
            met, old = materialize(top(met), "met"), parts[:-1]
            parts = [met, frontier]
            discard(*old)
    raise RuntimeError("the edges have a cycle")


def topological_order(nodes: list[str], prod: list[tuple], test: list[tuple] = ()) -> list:
    """Exact order of a small graph on the driver: first over all edges with the ready nodes sorted, then over
    production edges alone for nodes that a test cycle left."""
    def run(rest: set, edges, done: list) -> None:
        waits = {n: {d for s, d in edges if s == n and d in rest and d != n} for n in rest}
        users: dict = {}
        for n, ds in waits.items():
            for d in ds:
                users.setdefault(d, []).append(n)
        ready = sorted(n for n, ds in waits.items() if not ds)
        while ready:
            n = ready.pop(0)
            done.append(n)
            rest.discard(n)
            for u in users.get(n, ()):
                waits[u].discard(n)
                if not waits[u]:
                    ready.append(u)
            ready.sort()

    done, rest = [], set(nodes)
    run(rest, [*prod, *test], done)
    run(rest, list(prod), done)
    return done + sorted(rest)


def before(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """pairs (a, b), order (node, pos): false where either is missing."""
    x = pairs.join(order.select(F.col("node").alias("a"), F.col("pos").alias("pa")), "a", "left").join(order.select(F.col("node").alias("b"), F.col("pos").alias("pb")), "b", "left")
    return x.select("a", "b", F.coalesce(F.col("pa") < F.col("pb"), F.lit(False)).alias("is_before"))


def schedulable_deps(edges: DataFrame, nodes: DataFrame, order: DataFrame) -> DataFrame:
    """Dependencies on roots that come before the node in the order: (node, dep)."""
    roots = nodes.where("is_root").select(F.col("node").alias("dst"))
    e = edges.select("src", "dst").distinct().join(roots, "dst", "left_semi")
    e = e.join(order.select(F.col("node").alias("src"), F.col("pos").alias("ps")), "src").join(order.select(F.col("node").alias("dst"), F.col("pos").alias("pd")), "dst")
    return e.where("pd < ps").select(F.col("src").alias("node"), F.col("dst").alias("dep"))


def affected(changed: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Nodes whose old or new dependencies reach a changed one."""
    seeds = changed.select(F.col("node").alias("seed"))
    return closure(seeds, old_edges).unionByName(closure(seeds, new_edges)).select("node").distinct()


def ordered_closure(seeds: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    return closure(seeds, edges).where("seed != node").join(order, "node").orderBy("seed", "pos")


def load(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """packages (pkg_path, seq, imports, test_imports, for_test) -> (nodes, edges). Ordinary packages come
    first, the first of a path wins; an in-package test variant only adds imports to its package; an external
    one is a node of its own."""
    own = F.col("for_test").isNull() | (F.col("for_test") != F.col("pkg_path"))
    first = packages.where(own).groupBy("pkg_path").agg(F.min(F.struct(F.col("for_test").isNotNull().alias("late"), "seq", "imports", "test_imports")).alias("p"))
    extra = packages.where(~own).select("pkg_path", F.explode_outer(F.concat(F.coalesce("imports", F.array()), F.coalesce("test_imports", F.array()))).alias("dst"))
    prod = first.select(F.col("pkg_path").alias("src"), F.explode_outer("p.imports").alias("dst"))
    test = first.select(F.col("pkg_path").alias("src"), F.explode_outer("p.test_imports").alias("dst")).unionAll(extra.withColumnRenamed("pkg_path", "src"))
    prod = prod.where("dst IS NOT NULL").distinct()
    test = test.where("dst IS NOT NULL AND dst != src").distinct().join(prod, ["src", "dst"], "left_anti")
    return first.select(F.col("pkg_path").alias("node")), prod.withColumn("kind", F.lit("prod")).unionByName(test.withColumn("kind", F.lit("test")))
