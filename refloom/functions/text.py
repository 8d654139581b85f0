"""Column functions over text: positions, identifiers, words, line maps, edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(s: Column) -> Column:
    """UTF-16 code units: astral characters count twice."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def utf16_column(line: Column, byte_col: Column) -> Column:
    """0-based UTF-16 column of a 1-based byte column; null inside a character or past the end of the line."""
    raw = F.encode(line, "UTF-8")
    head = F.substring(raw, F.lit(1), byte_col - 1)
    whole = (byte_col >= 1) & (byte_col <= F.octet_length(line) + 1) & F.is_valid_utf8(head.cast("string"))
    return F.when(whole, utf16_length(head.cast("string")))


def ident_before(s: Column) -> Column:
    """The identifier that ends a string, scanning back; empty if there is none."""
    return F.regexp_extract(s, r"[\p{L}\p{Nd}_]*$", 0)


def word_count(s: Column, word: str) -> Column:
    """Occurrences of an ASCII word with ASCII word borders."""
    import re

    return F.regexp_count(s, F.lit(rf"\b{re.escape(word)}\b"))


def is_directive(s: Column) -> Column:
    return s.rlike(r"^//line |^//[a-z0-9]+:[a-z0-9]")


def dirty_line(old: Column, new: Column, line: Column) -> Column:
    """Where a line (1-based) of the old text is in the new one: unchanged above the first difference, else
    shifted by the difference in length; out of range: as it is. old and new are arrays of lines."""
    same = F.zip_with(F.slice(old, F.lit(1), F.least(F.size(old), F.size(new))), F.slice(new, F.lit(1), F.least(F.size(old), F.size(new))), lambda a, b: a == b)
    first = F.array_position(same, F.lit(False))
    head = F.when(first == 0, F.least(F.size(old), F.size(new))).otherwise(first - 1)
    moved = line + F.size(new) - F.size(old)
    return F.when(line <= head, line).when((moved >= 1) & (moved <= F.size(new)), moved).otherwise(line)


def common_ends(a: Column, b: Column) -> Column:
    """struct(prefix, suffix): equal lines at both ends of two arrays; the suffix takes what the prefix left."""
    short = F.least(F.size(a), F.size(b))
    run = lambda x, y, n: F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p == q), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + F.when(s["go"] & e, 1).otherwise(0)).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])
    prefix = run(a, b, short)
    return F.struct(prefix.alias("prefix"), F.least(run(F.reverse(a), F.reverse(b), short), short - prefix).alias("suffix"))


def apply_changes(text: Column, edits: Column) -> Column:
    """Edits array<struct<start int, stop int, text string>> (0-based characters), each against the text that
    the one before it made; a range outside the text is an error, not a clamp."""
    def one(t, e):
        ok = (e["start"] >= 0) & (e["start"] <= e["stop"]) & (e["stop"] <= F.length(t))
        made = F.concat(F.substring(t, F.lit(1), e["start"]), e["text"], F.substring(t, e["stop"] + 1, F.length(t)))
        return F.when(ok, made).otherwise(F.raise_error(F.lit("edit outside the text")).cast("string"))

    return F.aggregate(edits, text, one)


def merged_settings(json: Column, defaults: dict[str, int]) -> Column:
    """The defaults with the keys that a client's JSON object gives in their place; keys without a default are dropped,
    and so are values that aren't numbers. Null or broken JSON leaves the defaults."""
    own = F.from_json(json, "map<string,long>")
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.try_element_at(own, F.lit(k)), F.lit(v).cast("long")).alias("value")) for k, v in defaults.items()]))


def kind_requested(only: Column, kind: Column) -> Column:
    """No filter, an equal kind, or a parent kind that ends at a dot."""
    return (F.size(only) == 0) | F.exists(only, lambda o: (kind == o) | F.startswith(kind, F.concat(o, F.lit("."))))


def clean_path(path: Column) -> Column:
    """A path without `.`, empty and `..` segments; the root stays the root."""
    up = lambda done, seg: F.when(seg.isin("", "."), done).when(seg != "..", F.concat(done, F.array(seg))).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), up)
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def relative(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path)


def absolute(path: Column, root: str) -> Column:
    return clean_path(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)))


def inside(path: Column, root: str) -> Column:
    p = clean_path(path)
    return (p == root) | F.startswith(p, F.lit(root.rstrip("/") + "/"))


def tail(s: Column, n: int = 32768) -> Column:
    """The last n bytes behind a notice, if there are more; a character that the cut would split goes too."""
    raw = F.encode(s, "UTF-8")
    end = F.substring(raw, F.octet_length(s) - n + 1, F.lit(n))
    inner = lambda k: F.substring(raw, F.octet_length(s) - n + 1 + k, F.lit(n))
    first = lambda b: F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")
    part = lambda b: (first(b) >= 128) & (first(b) < 192)
    whole = F.when(~part(end), end).when(~part(inner(1)), inner(1)).when(~part(inner(2)), inner(2)).otherwise(inner(3))
    return F.when(F.octet_length(s) > n, F.concat(F.lit("[truncated]\n"), whole.cast("string"))).otherwise(s)


def percent(done: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0)).otherwise(F.expr("0") + F.floor(done * 100 / total))


def assumed_name(path: Column) -> Column:
    """Last segment of an import path, without a version segment."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.rlike(r"^v[0-9]+$"))
    return F.try_element_at(parts, F.lit(-1))


def active_argument(ends: Column, pos: Column, params: Column, variadic: Column) -> Column:
    """Index of the first argument that ends at or behind pos; variadic calls clamp to the last parameter."""
    at = F.array_position(F.transform(ends, lambda e: e >= pos), F.lit(True)) - 1
    at = F.when(at < 0, F.size(ends)).otherwise(at)
    return F.when(variadic & (at >= params), params - 1).otherwise(at)


def memory_limit(total: Column, share: float = 0.5, least: int = 4 << 30) -> Column:
    return F.greatest(F.lit(least), (total * share).cast("long"))


def generic_name(path: Column) -> Column:
    """A name for a package that couldn't be loaded: the last segment, letters and digits only, never empty."""
    name = F.regexp_replace(assumed_name(path), r"[^\p{L}\p{Nd}_]", "_")
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("_")).otherwise(name)


BLOCK = 128  #: numbers that are summed up together


def _short_sums(lengths: Column, start: Column) -> Column:
    """start plus the running sums. They are gathered in a text, which grows by a copy of bytes; an array would be
    built anew from boxed numbers at each step."""
    zero = F.struct(start.cast("long").alias("at"), F.lit("").alias("s"))
    step = lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["s"], (a["at"] + v).cast("string"), F.lit(",")).alias("s"))
    text = F.aggregate(lengths, zero, step, lambda a: a["s"])
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("long"))


def running_sums(lengths: Column, start: int = 0) -> Column:
    """start plus the running sums of an array; a long one is summed by blocks, so the work is far from its square."""
    zero = F.lit(0).cast("long")

    def long(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK)), lambda b: F.slice(x, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
        totals = F.transform(blocks, lambda y: F.aggregate(y, zero, lambda a, v: a + v))
        before = F.concat(F.array(zero), _short_sums(totals, zero))
        return F.flatten(F.zip_with(blocks, before, lambda y, by: F.when(y.isNotNull(), _short_sums(y, by + start)).otherwise(F.array().cast("array<long>"))))

    # one element of an array around it, so that the lengths are worked out once
    return F.get(F.transform(F.array(lengths), lambda x: F.when(F.size(x) <= BLOCK, _short_sums(x, F.lit(start))).otherwise(long(x))), F.lit(0))


def word_places(line: Column, word: Column) -> Column:
    """1-based byte columns at which a word stands in a line, with ASCII word borders."""
    gaps = F.split(line, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E(?![A-Za-z0-9_])")), F.lit(-1))
    width = F.octet_length(word)
    ends = running_sums(F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: (F.octet_length(g) + width).cast("long")), 1)
    return F.when(F.size(gaps) > 1, F.transform(ends, lambda e: e - width)).otherwise(F.array().cast("array<long>"))


def receiver(name: Column) -> Column:
    """The receiver's type of a method's name `T.M` or `(*T).M`; null where there is none."""
    found = F.regexp_extract(name, r"^\(?\*?([^().*]+)\)?\.", 1)
    return F.when(found != "", found)


def diagnostic(message: Column) -> Column:
    """struct(code, name, severity) of a checker's message; what is merely unused is a warning."""
    unused_import, unused, undefined = r'^"([^"]+)" imported and not used', r"^declared and not used: (\w+)", r"^undefined: (\w+)"
    code = F.when(message.rlike(unused_import), "unused-import").when(message.rlike(unused), "unused").when(message.rlike(undefined), "undefined").otherwise("other")
    name = F.concat(*[F.regexp_extract(message, p, 1) for p in (unused_import, unused, undefined)])
    return F.struct(code.alias("code"), name.alias("name"), F.when(code.startswith("unused"), "warning").otherwise("error").alias("severity"))


def source_file(path: Column, suffix: str = ".go") -> Column:
    """Whether a file of a folder belongs to its package's sources: by suffix, not hidden, not set aside by `_`."""
    name = F.substring_index(path, "/", -1)
    return name.endswith(suffix) & ~name.startswith(".") & ~name.startswith("_")


def test_file(path: Column) -> Column:
    return source_file(path) & path.endswith("_test.go")
