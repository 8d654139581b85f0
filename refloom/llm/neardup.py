"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds its distinct shingles of SHINGLE words. Equal sets meet by digest first, so copies
are one vertex whatever their number. The sets' representatives walk TREES independent trees: each tree has
DEPTH minwise tokens of its own (32 bits each), and a set follows the branch of its token at each level. A
node of at most LEAF sets is compared exhaustively on MinHash signatures. Of a larger node the members'
commonest token at each position is found (a majority vote that partial results merge), the member that
agrees with it most stands for the node, and each member is compared with that one: a text and its variants
become one class however many there are. Larger nodes that still hold two classes or more are branched
again, a level for each further token, now and then to two children, so that a pair at the threshold keeps
about one common path.

Candidates that pass the signature estimate and the size bound are confirmed on the full sets: a link needs
100 * intersection >= percent * union. A spanning forest of best estimates of each leaf and the large nodes'
chosen members come first. Then all sets of leaves with a candidate in another class, and all members of
nodes that are still large and of several classes at the last level, go through an exact prefix-filter join:
two sets that meet the threshold share one of their rarest tokens, so every link between classes that are
still apart is found. Links make components, without the driver.

Recall: a pair at similarity s misses all trees at the first level with probability (1 - s) ** TREES, 1e-10
at 0.85 and 4e-9 at 0.8. The estimate's margin drops such a pair with probability 1e-6. Pairs that meet in large nodes
alone pass the deeper levels in each tree on its own, and the last level has an exact way.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text of fewer than
SHINGLE words is one shingle; rows with one id are one vertex; a row without an id takes part in no link of
its own, its component is that of an equal set with an id, else null; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import discard, few, mapped_texts, materialize, tidy
from refloom.llm.components import components

SHINGLE = 5
PERCENT = 85
TREES = 12
DEPTH = 5  #: levels of a tree, each with a minwise token of its own
POSITIONS = TREES * DEPTH  #: minwise tokens of a signature
LEAF = 256
CELLS = 1 << 18  #: counters of tokens, by hash, that give the order of tokens in the prefix-filter join
BLOCK = 1 << 12  #: counters in a row
PIVOTS = 3  #: members of a large node that all others are compared with, chosen independently
MARGIN = 5.0  #: standard deviations below the threshold at which a signature still passes
_R = np.random.default_rng(85)
_MULT = _R.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _R.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the words of a text; A-Z are lower-cased, words end
    at ASCII white space."""
    import xxhash

    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(size, len(words))
    place = _PLACE if size == SHINGLE else np.random.default_rng(size).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = _mix(total + h[i : len(h) - k + 1 + i] * place[i])
    return np.unique(total)


def signature(s: np.ndarray) -> np.ndarray:
    """32 bits of the smallest token under each of POSITIONS orders."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[at : at + 4096, None] * _MULT).min(0))
    return (_mix(low) >> np.uint64(32)).astype("<u4").view("<i4")


def sketches(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n long, digest string, sig array<int>); digest and sig are null for an empty set."""

    def fill(texts):
        import xxhash

        n, d, s = [], [], []
        for t in texts:
            x = shingle_set(t, size)
            n.append(len(x))
            d.append(xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None)
            s.append(signature(x) if len(x) else None)
        return n, d, s

    return mapped_texts(docs, fill, "n long, digest string, sig array<int>", text, id_col)


def _estimate(percent: int) -> float:
    """Positions that two signatures have in common at least, to be candidates."""
    j = percent / 100
    return POSITIONS * j - MARGIN * (POSITIONS * j * (1 - j)) ** 0.5


def _token(tree: Column, level: int, turn: Column | int = 0) -> Column:
    """The token by which a tree branches at a level; later turns take those of the trees behind it."""
    return F.get("sig", ((tree + turn) % TREES * DEPTH + level).cast("int"))


def _roots(reps: DataFrame) -> DataFrame:
    """reps (id, sig) -> (tree, key, id): the nodes of the first level."""
    keys = F.array(*[F.xxhash64(F.lit(t), _token(F.lit(t), 0)) for t in range(TREES)])
    return reps.select("id", F.posexplode(keys).alias("tree", "key")).select("tree", "key", "id")


def branch_count(key: Column, percent: int) -> Column:
    """Children of a node: 100 / percent on average, chosen by the node's key."""
    return F.least(F.lit(TREES), F.floor(F.lit(100 / percent) + F.pmod(F.xxhash64(key, F.lit("turn")), F.lit(1 << 20)) / (1 << 20)).cast("int"))


def _branches(rows: DataFrame, level: int, percent: int) -> DataFrame:
    """rows (tree, key, id, sig) -> (tree, key, id) of the next level's nodes."""
    turns = F.sequence(F.lit(0), branch_count(F.col("key"), percent) - 1)
    child = lambda n: F.xxhash64("key", F.lit(level), n, _token(F.col("tree"), level, n))
    return rows.select("tree", "id", F.explode(F.transform(turns, child)).alias("key")).select("tree", "key", "id")


def whole_groups(batches, key: str):
    """Frames of batches sorted by key, cut where the key changes."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        cut = int(b[key].searchsorted(b[key].iloc[-1])) if len(b) else 0
        rest = b.iloc[cut:]
        yield b.iloc[:cut]
    if rest is not None:
        yield rest


def runs(key: np.ndarray):
    """(start, end) of the runs of equal keys."""
    edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.zeros(1, dtype=int)
    return zip(edges[:-1], edges[1:])


def _commonest(sig: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The commonest value of each column, by weight, and by how much it leads: what a majority vote keeps."""
    order = np.argsort(sig, axis=0, kind="stable")
    values = np.take_along_axis(sig, order, 0)
    w = np.ones(sig.shape, dtype=np.int64) if weight is None else np.take_along_axis(weight, order, 0)
    best, lead = np.zeros(sig.shape[1], dtype=np.int32), np.zeros(sig.shape[1], dtype=np.int64)
    for k in range(sig.shape[1]):
        at = np.r_[0, np.flatnonzero(values[1:, k] != values[:-1, k]) + 1]
        sums = np.add.reduceat(w[:, k], at)
        j = int(sums.argmax())
        best[k], lead[k] = values[at[j], k], max(0, 2 * sums[j] - sums.sum())
    return best, lead


def _stars(large: DataFrame, reps: DataFrame, percent: int, n: int) -> DataFrame:
    """large (tree, key, id) -> pairs (a, b), a < b: each member of a node beside the member nearest to the
    node's majority, and one or two more that are as near, if size and estimate let them be linked."""
    rows = materialize(few(large.select("key", "id").join(reps.hint("merge"), "id"), TREES * n, 50_000).sortWithinPartitions("key").select("key", "id", "n", "sig"), "large")

    def vote(batches):
        for b in batches:
            order = np.argsort(b["key"].to_numpy(), kind="stable")
            key, sig = b["key"].to_numpy()[order], np.stack(b["sig"].to_list())[order] if len(b) else np.zeros((0, POSITIONS), dtype=np.int32)
            got = [(key[s], *_commonest(sig[s:e])) for s, e in runs(key)]
            if got:  # an empty column of lists has no type
                yield pd.DataFrame({"key": [g[0] for g in got], "token": [g[1] for g in got], "lead": [g[2] for g in got]})

    def count(batches):
        for b in whole_groups(batches, "key"):
            key = b["key"].to_numpy()
            got = [(key[s], _commonest(np.stack(b["token"].iloc[s:e].to_list()), np.stack(b["lead"].iloc[s:e].to_list()))[0]) for s, e in runs(key)]
            if got:
                yield pd.DataFrame({"key": [g[0] for g in got], "token": [g[1] for g in got]})

    votes = rows.select("key", "sig").mapInPandas(vote, "key long, token array<int>, lead array<long>")
    most = materialize(few(votes.repartition("key").sortWithinPartitions("key"), n).mapInPandas(count, "key long, token array<int>"), "majority")
    agree = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same))
    near = rows.join(most.hint("merge"), "key").select("key", "id", agree("sig", "token").alias("agree"))
    # of those that agree equally well any may be the one that the others vary, so each node chooses by other hashes
    best = lambda turn: F.max(F.struct("agree", F.xxhash64("key", "id", F.lit(turn)), "id"))["id"]
    chosen = near.groupBy("key").agg(F.array_distinct(F.array(*[best(k) for k in range(PIVOTS)])).alias("p")).select("key", F.explode("p").alias("pivot"))
    chosen = materialize(few(chosen.join(reps.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("sig").alias("own")).hint("merge"), "pivot"), n), "pivots")
    sized = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    met = rows.join(chosen.hint("merge"), "key").where((F.col("id") != F.col("pivot")) & sized & (agree("sig", "own") >= _estimate(percent)))
    out = materialize(few(met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), PIVOTS * n), "stars")
    discard(rows, most, chosen)
    return out


def _forest(agree: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of largest agreement; 0 means no edge. Prim's algorithm on the matrix."""
    out, n = [], len(agree)
    left = np.ones(n, dtype=bool)
    best, of = np.zeros(n, dtype=agree.dtype), np.zeros(n, dtype=np.int64)
    for _ in range(n):
        i = int(np.where(left, best, -1).argmax())
        if best[i]:
            out.append((int(of[i]), i))
        left[i] = False
        better = left & (agree[i] > best)
        best[better], of[better] = agree[i][better], i
    return out


def _compare_leaves(leaves: DataFrame, percent: int, forest: bool) -> DataFrame:
    """leaves (key, id, n, sig, class), whole nodes -> with `forest` pairs (a, b), a < b, a spanning forest of each
    node's candidates; else (id), the sets with a candidate in another class."""
    least = _estimate(percent)

    def pairs(ids, n, sig, cls):
        s = np.stack(sig)
        if len(ids) > 2:
            agree = np.zeros((len(ids), len(ids)), dtype=np.int16)
            for k in range(POSITIONS):
                agree += s[:, k, None] == s[None, :, k]
        else:
            agree = (s[:, None, :] == s[None, :, :]).sum(2).astype(np.int16)
        near = np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * percent
        ok = near & (agree >= least) & (ids[:, None] != ids)
        if forest:
            found = _forest(np.where(ok, agree, 0))
            return (ids[[x for x, _ in found]], ids[[y for _, y in found]]) if found else (ids[:0], ids[:0])
        apart = ids[(ok & (cls[:, None] != cls)).any(1)]
        return apart, apart

    def fill(batches):
        for b in whole_groups(batches, "key"):
            out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            key, ids, n, sig, cls = b["key"].to_numpy(), b["id"].to_numpy(), b["n"].to_numpy(), b["sig"].tolist(), b["class"].to_numpy()
            for s, e in runs(key):
                if e - s > 1 and (forest or (cls[s:e] != cls[s]).any()):
                    a, z = pairs(ids[s:e], n[s:e], sig[s:e], cls[s:e])
                    out_a.append(np.minimum(a, z))
                    out_b.append(np.maximum(a, z))
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)} if forest else {"id": np.concatenate(out_a)})
        tidy()

    return leaves.repartition("key").sortWithinPartitions("key", "id").mapInPandas(fill, "a long, b long" if forest else "id long").distinct()


def _counters(sets: DataFrame) -> np.ndarray:
    """How often tokens of each of CELLS hash classes occur in sets (id, class, s): of fixed size, whatever the table."""

    def fill(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            for s in b["s"]:
                np.add.at(total, (np.frombuffer(s, dtype=np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        blocks = [k for k in range(0, CELLS, BLOCK) if total[k : k + BLOCK].any()]
        yield pd.DataFrame({"block": blocks, "counts": [total[k : k + BLOCK].tobytes() for k in blocks]}).astype({"block": "int64"})

    def add(key, b):
        return pd.DataFrame({"block": [key[0]], "counts": [sum(np.frombuffer(c, dtype=np.int64) for c in b["counts"]).tobytes()]})

    out = np.zeros(CELLS, dtype=np.int64)
    kind = "block long, counts binary"
    for k, c in sets.select("s").mapInPandas(fill, kind).groupBy("block").applyInPandas(add, kind).collect():
        out[k : k + BLOCK] = np.frombuffer(c, dtype=np.int64)
    return out


def apart(members: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """members (id, class), of docs (id, text) -> pairs (a, b), a < b, of different classes, among them all whose
    sets meet the threshold.

    Tokens are ordered by how often they occur, rare ones first (any fixed order gives the same links). Two sets
    that meet the threshold have their first common token among the first n - ceil(percent * n / 100) + 1 of either,
    and no fewer tokens from there on than the threshold asks them to share."""

    def fill(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "class": b["class"], "s": [shingle_set(t, size).tobytes() for t in b["text"]]})
        tidy()

    sets = materialize(docs.join(members.hint("merge"), "id").select("id", "class", "text").mapInPandas(fill, "id long, class long, s binary").where("length(s) > 0"), "members")
    counts = _counters(sets)

    def prefixes(batches):
        for b in batches:
            ids, classes, sizes, tokens, left = [], [], [], [], []
            for i, c, s in zip(b["id"].tolist(), b["class"].tolist(), b["s"]):
                s = np.frombuffer(s, dtype=np.uint64)
                n = len(s)
                first = n + (-percent * n // 100) + 1
                order = np.lexsort((s, counts[(s % np.uint64(CELLS)).astype(np.int64)]))[:first]
                ids.append(np.full(first, i, dtype=np.int64))
                classes.append(np.full(first, c, dtype=np.int64))
                sizes.append(np.full(first, n, dtype=np.int32))
                tokens.append(s[order].view(np.int64))
                left.append(np.arange(n, n - first, -1, dtype=np.int32))
            if ids:
                yield pd.DataFrame({"token": np.concatenate(tokens), "id": np.concatenate(ids), "class": np.concatenate(classes), "n": np.concatenate(sizes), "left": np.concatenate(left)})

    rows = materialize(sets.mapInPandas(prefixes, "token long, id long, class long, n int, left int"), "prefixes")
    # of a token's rows, those outside its largest class meet all others: pairs within that class aren't formed
    by_class = rows.groupBy("token", "class").agg(F.count("*").alias("rows"))
    shared = by_class.groupBy("token").agg(F.max(F.struct("rows", "class"))["class"].alias("major"), F.count("*").alias("classes")).where("classes > 1").select("token", "major")
    rows = materialize(rows.join(shared.hint("merge"), "token"), "shared")
    x = rows.where("class != major").selectExpr("token", "id AS a", "class AS ca", "n AS na", "left AS la")
    y = rows.selectExpr("token AS other", "id AS b", "class AS cb", "n AS nb", "left AS lb")
    near = f"token = other AND ca != cb AND least(na, nb) * 100L >= greatest(na, nb) * {percent}L AND least(la, lb) * {100 + percent}L >= {percent}L * (na + nb)"
    return x.join(y.hint("merge"), F.expr(near)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def descend(large: DataFrame, known: DataFrame, percent: int, n: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """large (tree, key, id), members of nodes of more than LEAF sets; known (id, n, sig, class) -> the leaves (key, id)
    below those of several classes, by level, and the members (id) of those that are large at the last level."""
    leaves, members = [], []
    for level in range(1, DEPTH + 1):
        rows = large.join(known.select("id", "class").hint("merge"), "id")
        nodes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key", "size")
        open_rows = materialize(few(rows.join(nodes.hint("merge"), "key").select("tree", "key", "id", "size"), TREES * n), f"open{level}")
        if level > 1:
            leaves.append(open_rows.where(F.col("size") <= LEAF).select("key", "id"))
        rest = open_rows.where(F.col("size") > LEAF)
        if not rest.limit(1).count():
            break
        if level == DEPTH:
            members.append(rest.select("id"))
            break
        large = materialize(_branches(few(rest.join(known.select("id", "sig").hint("merge"), "id"), TREES * n, 50_000), level, percent), f"level{level}")
    return leaves, members


def linked(reps: DataFrame, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Confirmed links (a, b) that make the same components as all links do. First a spanning forest of each
    leaf's candidates is confirmed, and each large node's star; then an exact join finds what would join two
    classes, so a family of many alike isn't compared pair by pair."""
    n = reps.count()
    rows = materialize(_roots(reps), "roots")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    nodes = materialize(few(rows.join(sizes.hint("merge"), "key"), TREES * n), "nodes")
    leaves, large = nodes.where(F.col("size") <= LEAF).select("key", "id"), nodes.where(F.col("size") > LEAF).select("tree", "key", "id")
    first = _compare_leaves(leaves.join(reps, "id").withColumn("class", F.col("id")), percent, True)
    any_large = large.limit(1).count() > 0
    first = materialize(few(first.unionAll(_stars(large, reps, percent, n)).distinct() if any_large else first, TREES * n), "forest")
    one = materialize(few(confirmed(first, docs, percent, size).select("a", "b").distinct(), TREES * n), "links1")
    classes = components(one.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = materialize(few(reps.join(classes.hint("merge"), "id", "left").select("id", "n", "sig", F.coalesce("root", "id").alias("class")), n, 50_000), "known")
    deeper, last = descend(large, known, percent, n) if any_large else ([], [])
    for x in deeper:
        leaves = leaves.unionAll(x)
    members = _compare_leaves(leaves.join(known, "id"), percent, False)
    for x in last:
        members = members.unionAll(x)
    members = materialize(few(members.distinct(), n), "open").join(known.select("id", "class").distinct(), "id")
    rest = materialize(few(apart(members, docs, percent, size).join(first, ["a", "b"], "left_anti"), TREES * n), "rest")
    two = confirmed(rest, docs, percent, size).select("a", "b")
    out = materialize(few(one.unionAll(two).distinct(), TREES * n), "links")
    discard(rows, nodes, first, one, known, rest)
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of documents (id, text) whose full sets meet the threshold: (a, b, shared, total)."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()

    def sets(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "s": [shingle_set(t, size).tobytes() for t in b["text"]]})
        tidy()

    s = materialize(docs.join(ids, "id", "left_semi").mapInPandas(sets, "id long, s binary"), "sets", "none")
    left = pairs.join(s.select(F.col("id").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
    both = left.join(s.select(F.col("id").alias("b"), F.col("s").alias("y")).hint("merge"), "b")

    def check(batches):
        for b in batches:
            rows = []
            for i, j, x, y in zip(b["a"].tolist(), b["b"].tolist(), b["x"], b["y"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - shared
                if shared and 100 * shared >= percent * total:
                    rows.append((i, j, shared, total))
            yield pd.DataFrame(rows, columns=["a", "b", "shared", "total"])

    return both.select("a", "b", "x", "y").mapInPandas(check, "a long, b long, shared long, total long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each input row."""
    d = docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text")
    sk = materialize(sketches(d, "text", "id", size), "sketches")
    rows = sk.count()
    firsts = materialize(few(sk.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), rows), "firsts")
    own = sk.where("digest IS NOT NULL").join(firsts.hint("merge"), (sk["doc_id"] == firsts["rep"]) & (sk["digest"] == firsts["digest"]), "left_semi")
    reps = materialize(few(own.select(F.col("doc_id").alias("id"), "n", "sig").dropDuplicates(["id", "sig"]), rows, 20_000), "reps")
    links = linked(reps, d.join(reps.select("id").distinct(), "id", "left_semi"), percent, size)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    state = materialize(few(firsts.join(roots, firsts["rep"] == roots["id"], "left").select("digest", F.coalesce("root", "rep").alias("root")), rows), "state")
    out = sk.select("doc_id", "n", "digest").join(state.hint("merge"), "digest", "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), (F.col("doc_id") == root).alias("kept"))


def without_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id: all columns, unchanged. Equal rows (id
    and text) are one document and come once; different texts under one id are several. A row without an id
    stays unless its text is a near-duplicate of another that stays; without words, too, it always stays."""
    own = docs.withColumn("_v", F.xxhash64(id_col, text))
    groups = near_duplicates(own, text, "_v", percent).select("doc_id", "n_shingles", "component_id").distinct()
    ids = own.select(F.col("_v").alias("doc_id"), F.col(id_col).alias("_id")).distinct()
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "doc_id"))["doc_id"].alias("_kept")
    kept = groups.join(ids, "doc_id").groupBy("component_id").agg(first, F.max("n_shingles").alias("_n"))
    rows = own.join(materialize(kept.select("_kept", "_n"), "kept"), F.col("_v") == F.col("_kept"))
    loose = F.col(id_col).isNull() & (F.col("_n") == 0)
    return rows.where(loose).unionAll(rows.where(~loose).dropDuplicates(["_v"])).select(docs.columns)
