"""Per-document transforms: token deltas, call folding, line diffs, outlines, folding ranges, lenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_deltas(tokens: DataFrame) -> DataFrame:
    """(doc_id, line, col) -> differences of line and column to the token before; the column starts anew on
    each line."""
    w = Window.partitionBy("doc_id").orderBy("line", "col")
    line, col = F.lag("line").over(w), F.lag("col").over(w)
    t = tokens.withColumn("_l", F.coalesce(line, F.lit(1))).withColumn("_c", F.coalesce(col, F.lit(1)))
    return t.withColumn("d_line", F.col("line") - F.col("_l")).withColumn("d_col", F.when(F.col("line") == F.col("_l"), F.col("col") - F.col("_c")).otherwise(F.col("col") - 1)).drop("_l", "_c")


def fold_calls(calls: DataFrame, keys: list[str]) -> DataFrame:
    """One row for a caller and callee with all ranges in order."""
    return calls.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", "col", "end_col"))).alias("ranges"), F.count("*").alias("n_calls"))


def first_calls(calls: DataFrame, keys: list[str]) -> DataFrame:
    """One row for a caller and callee with the number of ranges and the first one's place."""
    f = calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.min(F.col("line") * (1 << 31) + F.col("col")).alias("p"))
    return f.select(*keys, "n_calls", F.floor(F.col("p") / (1 << 31)).alias("first_line"), (F.col("p") % (1 << 31)).alias("first_col"))


def enclosing(places: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """places (doc_id, line, ...) with the outermost span (doc_id, start, stop, depth, name) that holds them. Spans meet
    places by blocks of `bucket` lines, so a document's places don't meet all its spans."""
    cut = spans.select("*", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.greatest("stop", F.col("start") + 1) - 1) / bucket))).alias("_b"))
    hit = places.withColumn("_b", F.floor(F.col("line") / bucket)).join(cut, ["doc_id", "_b"]).where("start <= line AND line < stop")
    keys = places.columns  # a place is in one block: with it, nothing is shuffled again
    return hit.groupBy(*keys, "_b").agg(F.min(F.struct("depth", "start", "name")).alias("s")).select(*keys, F.col("s.name").alias("enclosing"))


def lines_of(text: str) -> list[str]:
    """Lines with their ends; only a line feed ends one."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def line_edits(before: str, after: str) -> list[tuple[int, int, str]]:
    """A shortest line diff: (start, stop, new text) over lines of `before`, ends exclusive. Common ends are
    taken off first; then the middle of a shortest path is sought from both sides (Myers 1986, section 4b) and
    both halves follow, so memory is in proportion to the lines however different the texts are."""
    a, b = lines_of(before), lines_of(after)
    number: dict[str, int] = {}
    x, y = ([number.setdefault(line, len(number)) for line in t] for t in (a, b))
    edits: list[list] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and x[lo] == y[left]:
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and x[hi - 1] == y[right - 1]:
            hi, right = hi - 1, right - 1
        if lo == hi or left == right:
            if lo < hi or left < right:
                if edits and edits[-1][1] == lo and edits[-1][3] == left:
                    edits[-1][1], edits[-1][3] = hi, right
                else:
                    edits.append([lo, hi, left, right])
            continue
        at, to = _middle(x[lo:hi], y[left:right])
        todo += [(lo + at, hi, left + to, right), (lo, lo + at, left, left + to)]
    return [(lo, hi, "".join(b[left:right])) for lo, hi, left, right in edits]


def _middle(x: list[int], y: list[int]) -> tuple[int, int]:
    """A point on a shortest path from (0, 0) to the far corner, neither of which it is. x and y differ at both ends.
    Two fronts, one from either corner, keep their furthest x for each diagonal that lies in the grid."""
    n, m = len(x), len(y)
    shift, fronts = n - m, ({}, {})
    ways = ((x, y), (x[::-1], y[::-1]))
    for d in range((n + m + 1) // 2 + 1):
        for way, (p, q) in enumerate(ways):
            mine, other = fronts[way], fronts[1 - way]
            for k in range(2 * max(0, d - m) - d, d - 2 * max(0, d - n) + 1, 2):
                down = k == -d or (k != d and mine.get(k - 1, 0) < mine.get(k + 1, 0))
                i = mine.get(k + 1, 0) if down else mine.get(k - 1, 0) + 1
                while i < n and i - k < m and p[i] == q[i - k]:
                    i += 1
                mine[k] = i
                met = shift - k
                if shift % 2 == 1 - way and abs(met) <= d - 1 + way and i + other.get(met, 0) >= n:
                    return (i, i - k) if way == 0 else (n - i, m - (i - k))
    raise AssertionError("paths from both corners meet")


def diff_lines(pairs: DataFrame) -> DataFrame:
    """pairs (id, before, after) -> (id, start, stop, start_byte, stop_byte, new_text): lines and bytes of the text before,
    ends exclusive. Null texts are empty."""

    def fill(batches):
        from itertools import accumulate

        import pandas as pd

        for p in batches:
            rows = []
            for i, x, y in zip(p["id"].tolist(), p["before"], p["after"]):
                found = line_edits(x or "", y or "")
                at = [0, *accumulate(len(line.encode()) for line in lines_of(x or ""))] if found else []
                rows += [(i, a, b, at[a], at[b], new) for a, b, new in found]
            yield pd.DataFrame(rows, columns=["id", "start", "stop", "start_byte", "stop_byte", "new_text"])

    return pairs.select("id", "before", "after").mapInPandas(fill, "id long, start long, stop long, start_byte long, stop_byte long, new_text string")


def apply_line_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts (id, before), edits of diff_lines() -> (id, after): the pieces between the edits and the new texts, joined."""
    by = edits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "stop_byte", "new_text"))).alias("e"))
    d = texts.select("id", F.encode(F.coalesce("before", F.lit("")), "UTF-8").alias("raw")).join(by, "id", "left").withColumn("e", F.coalesce("e", F.expr("array()")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("e", lambda x: x["stop_byte"]))
    begins = F.concat(F.transform("e", lambda x: x["start_byte"]), F.array(F.octet_length("raw").cast("long")))
    kept = F.zip_with(ends, begins, lambda a, b: F.substring("raw", (a + 1).cast("int"), (b - a).cast("int")))
    new = F.concat(F.transform("e", lambda x: F.encode(x["new_text"], "UTF-8")), F.array(F.encode(F.lit(""), "UTF-8")))
    pieces = F.zip_with(kept, new, lambda a, b: F.concat(a, b))
    return d.select("id", F.decode(F.aggregate(pieces, F.encode(F.lit(""), "UTF-8"), lambda s, p: F.concat(s, p)), "UTF-8").alias("after"))


def outline(symbols: DataFrame) -> DataFrame:
    """symbols (file, seq, name, kind, parent) -> (file, place, depth, seq, name, kind): types first, then the others in
    order; a method hangs under its receiver if that is in the same file, else it is at the top; `_` is skipped for
    values."""
    named = symbols.where("NOT (name = '_' AND kind IN ('var', 'const'))")
    types = named.where("kind = 'type'").groupBy("file", F.col("name").alias("parent")).agg(F.min("seq").alias("parent_seq"))
    x = named.join(types, ["file", "parent"], "left").withColumn("parent_seq", F.when(F.col("kind") == "method", F.col("parent_seq")))
    top = F.when((F.col("kind") == "type") | F.col("parent_seq").isNotNull(), 0).otherwise(1)
    depth = F.when(F.col("parent_seq").isNull(), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("file").orderBy(top, F.coalesce("parent_seq", "seq"), depth, "seq"))
    return x.select("file", place.alias("place"), depth.alias("depth"), "seq", "name", "kind")


def folding(blocks: DataFrame) -> DataFrame:
    """Blocks that span more than one line, by their start."""
    return blocks.where("stop_line > start_line").orderBy("file", "start_line", "stop_line")


def in_ranges(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """tokens (doc_id, start, stop, ...), ranges (doc_id, from, to), one for a document: tokens that overlap it."""
    return tokens.join(ranges, "doc_id").where("start < `to` AND stop > `from`").drop("from", "to")


def selection_ranges(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """places (doc_id, at), nodes (doc_id, start, stop), ends exclusive -> with `step`: the ranges that hold a place,
    innermost first."""
    hit = places.join(nodes, "doc_id").where("start <= at AND at < stop").distinct()
    return hit.withColumn("step", F.row_number().over(Window.partitionBy("doc_id", "at").orderBy(F.col("stop") - F.col("start"), "start")))


def test_lenses(functions: DataFrame) -> DataFrame:
    """functions (file, name, param) -> tests and benchmarks of test files."""
    test = F.col("name").rlike("^Test([^a-z]|$)") & (F.col("param") == "*testing.T")
    bench = F.col("name").rlike("^Benchmark([^a-z]|$)") & (F.col("param") == "*testing.B")
    return functions.where(F.col("file").endswith("_test.go")).withColumn("lens", F.when(test, "test").when(bench, "benchmark")).where("lens IS NOT NULL")


def file_lenses(lines: DataFrame) -> DataFrame:
    """lines (file, line, text) -> (file, lens, line): the first generate directive, the last import of C."""
    generate = F.min(F.when(F.col("text").startswith("//go:generate "), F.col("line")))
    cgo = F.max(F.when(F.col("text").rlike(r'^import\s+"C"'), F.col("line")))
    found = lines.groupBy("file").agg(generate.alias("generate"), cgo.alias("regenerate_cgo"))
    return found.select("file", F.explode(F.create_map(F.lit("generate"), "generate", F.lit("regenerate_cgo"), "regenerate_cgo")).alias("lens", "line")).where("line IS NOT NULL")


def split_lines(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, line, col, text) -> one row for each line of a token, empty pieces dropped: later ones begin at
    column 1."""
    pieces = tokens.select("doc_id", "line", "col", F.posexplode(F.split("text", "\n")).alias("k", "text")).where("text != ''")
    return pieces.select("doc_id", (F.col("line") + F.col("k")).alias("line"), F.when(F.col("k") == 0, F.col("col")).otherwise(1).alias("col"), "text")


def encode_tokens(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, line, start, length, kind, modifiers), 0-based UTF-16 places -> the protocol's five numbers: lines and
    starts as differences, to the token before on the same line, else to the line's begin."""
    w = Window.partitionBy("doc_id").orderBy("line", "start")
    before, at = F.coalesce(F.lag("line").over(w), F.lit(0)), F.coalesce(F.lag("start").over(w), F.lit(0))
    same = before == F.col("line")
    return tokens.select("doc_id", "line", "start", (F.col("line") - before).alias("d_line"), F.when(same, F.col("start") - at).otherwise(F.col("start")).alias("d_start"), "length", "kind", "modifiers")


def comment_edits(comments: DataFrame, asked: DataFrame, directive) -> DataFrame:
    """comments (owner, line, text), asked (owner, name, new_text) -> (owner, line, col, end_col, new_text): the whole-word
    places of a renamed symbol in its own comment; directive(text) tells the lines that aren't prose."""
    from refloom.functions.text import word_places

    hit = comments.where(~directive(F.col("text"))).join(asked, "owner")
    at = hit.select("owner", "line", F.explode(word_places(F.col("text"), F.col("name"))).alias("col"), "name", "new_text")
    return at.select("owner", "line", "col", (F.col("col") + F.octet_length("name")).alias("end_col"), "new_text")


def with_doc(symbols: DataFrame) -> DataFrame:
    """symbols (..., spec_doc, group_doc) with `doc`: a declaration's own comment before that of its group; empty is none."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return symbols.withColumn("doc", F.coalesce(text("spec_doc"), text("group_doc"))).drop("spec_doc", "group_doc")


def organized(imports: DataFrame) -> DataFrame:
    """imports (file, before array) -> (file, before, start, stop, put): one edit that makes the lines sorted and distinct, over
    the lines between the common ends; no row where nothing changes."""
    from refloom.functions.text import common_ends

    d = imports.withColumn("after", F.array_sort(F.array_distinct("before"))).withColumn("c", common_ends(F.col("before"), F.col("after")))
    d = d.where(~F.col("before").eqNullSafe(F.col("after")))
    put = F.slice("after", F.col("c.prefix") + 1, F.size("after") - F.col("c.prefix") - F.col("c.suffix"))
    return d.select("file", "before", F.col("c.prefix").alias("start"), (F.size("before") - F.col("c.suffix")).alias("stop"), put.alias("put"))


def inlay_hints(variables: DataFrame, arguments: DataFrame, enabled: DataFrame) -> DataFrame:
    """variables (file, line, end_col, name, type, how), how one of assign, range, const; arguments (file, line, col, place, param,
    params), place from 0; enabled (file, kind) -> (file, line, col, kind, label). Variables get their type, but `_`
    doesn't, constants their value; arguments get the name of their parameter, up to the last one that is declared."""
    kind = F.when(F.col("how") == "assign", "assignVariableTypes").when(F.col("how") == "range", "rangeVariableTypes").when(F.col("how") == "const", "constantValues")
    label = F.concat(F.when(F.col("how") == "const", F.lit("= ")).otherwise(F.lit(": ")), "type")
    v = variables.where("name != '_'").select("file", "line", F.col("end_col").alias("col"), kind.alias("kind"), label.alias("label"))
    a = arguments.where("place < params AND param != ''").select("file", "line", "col", F.lit("parameterNames").alias("kind"), F.concat("param", F.lit(":")).alias("label"))
    return v.where("kind IS NOT NULL").unionByName(a).join(enabled.select("file", "kind").distinct(), ["file", "kind"], "left_semi").select("file", "line", "col", "kind", "label")
