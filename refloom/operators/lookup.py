"""Point lookups, prefix scans, positions, ranking. Everything takes and returns DataFrames; a batch of
questions is a table, one question a table of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def unsigned(h: Column) -> Column:
    """Sort key that orders 64-bit hashes as unsigned numbers."""
    return h.bitwiseXOR(F.lit(SIGN))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def symbol_by_id(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """asked (pkg_hash, id_hash, ...) with the symbol of that id, the first by `seq` where an id is there more than
    once; symbols that don't exist are dropped."""
    once = first_of(symbols, ["pkg_hash", "id_hash"], ["seq"]) if "seq" in symbols.columns else symbols
    return asked.join(once, ["pkg_hash", "id_hash"])


def ref_at(positions: DataFrame, refs: DataFrame) -> DataFrame:
    """positions (doc_id, line, q_col), refs (doc_id, line, col, end_col, ...): the last ref that begins at or
    before the position, if it holds it; an earlier ref isn't tried."""
    payload = [c for c in refs.columns if c not in ("doc_id", "line")]
    near = positions.join(refs, ["doc_id", "line"]).where("col <= q_col")
    last = near.groupBy("doc_id", "line", "q_col").agg(F.max(F.struct(*["col", *[c for c in payload if c != "col"]])).alias("r"))
    return last.select("doc_id", "line", "q_col", "r.*").where("q_col < end_col")


def symbol_at(positions: DataFrame, decls: DataFrame) -> DataFrame:
    """The first declaration on the line whose span holds the position."""
    hit = positions.join(decls, ["doc_id", "line"]).where("col <= q_col AND q_col < end_col")
    return hit.groupBy("doc_id", "line", "q_col").agg(F.min(F.struct("col", "token")).alias("d")).select("doc_id", "line", "q_col", "d.token", "d.col")


def resolve_at(positions: DataFrame, occurrences: DataFrame, *more: str) -> DataFrame:
    """positions (doc_id, line, q_col), occurrences (doc_id, line, col, end_col, is_decl, ...) -> what stands there: the
    ref of ref_at(), else the declaration of symbol_at(), in one pass; positions on nothing are dropped."""
    row = F.struct("col", "end_col", "is_decl", *more)
    near = positions.join(occurrences, ["doc_id", "line"]).where("col <= q_col")
    last = F.max(F.when(~F.col("is_decl"), row)).alias("ref")
    here = F.min(F.when(F.col("is_decl") & (F.col("q_col") < F.col("end_col")), row)).alias("decl")
    hit = near.groupBy("doc_id", "line", "q_col").agg(last, here)
    hit = hit.withColumn("r", F.when(F.col("q_col") < F.col("ref.end_col"), F.col("ref")).otherwise(F.col("decl")))
    return hit.where("r IS NOT NULL").select("doc_id", "line", "q_col", "r.*")


def name_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes (prefix), names (name_lower, id_hash) -> (prefix, name_lower, hashes): names with the prefix, without regard
    to case; an empty prefix matches all. Prefixes meet names by their first two letters, which both have."""
    asked = prefixes.select("prefix", F.lower("prefix").alias("low")).distinct()
    by = names.groupBy("name_lower").agg(F.sort_array(F.collect_set("id_hash")).alias("hashes"))
    long = asked.where(F.length("low") >= 2).join(by, F.substring("low", 1, 2) == F.substring("name_lower", 1, 2))
    short = asked.where(F.length("low") < 2).join(by, F.col("name_lower").startswith(F.col("low")))
    return long.unionAll(short).where(F.col("name_lower").startswith(F.col("low"))).select("prefix", "name_lower", "hashes")


def workspace_symbol(symbols: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """The first `limit` symbols by name, then by unsigned hash."""
    return symbols.where(F.col("name_lower").startswith(prefix.lower())).orderBy("name_lower", unsigned(F.col("id_hash"))).limit(limit)


def import_candidates(symbols: DataFrame, name: str, own: Column, kinds: list[int], limit: int = 100) -> DataFrame:
    """Limit first, then the filter, then one row for a package."""
    top = workspace_symbol(symbols, name, limit)
    return top.where((F.col("name") == name) & F.col("kind").isin(*kinds) & (F.col("pkg_hash") != own)).groupBy("pkg_hash").agg(F.min("id_hash").alias("id_hash"))


def rank_prefix(labels: DataFrame, prefix: str, base: str = "") -> DataFrame:
    """Labels with the prefix in the same case rank 0, in another case 1; others are dropped."""
    low = F.lower("label").startswith(prefix.lower())
    rank = F.when(F.col("label").startswith(prefix), F.lit(base + "0")).when(low, F.lit(base + "1"))
    return labels.withColumn("sort_text", F.concat(rank, "label")).where("sort_text IS NOT NULL")


def completions(asked: DataFrame, symbols: DataFrame, base: str = "") -> DataFrame:
    """asked (scope, prefix, ...), symbols (scope, label, ...) with `sort_text`: what is in scope and has the prefix, those in
    the same case first."""
    hit = asked.join(symbols, "scope").where(F.lower("label").startswith(F.lower("prefix")))
    return hit.withColumn("sort_text", F.concat(F.when(F.col("label").startswith(F.col("prefix")), F.lit(base + "0")).otherwise(F.lit(base + "1")), "label"))


def chain(asked: DataFrame, keys: list[str], tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """asked (keys), tiers of (name, answers (keys, answer)): the answer of the first tier that has one, the least of it;
    asked rows without any are dropped."""
    found = None
    for n, (name, df) in enumerate(tiers):
        part = df.select(*keys, F.struct(F.lit(n).alias("n"), F.col("answer"), F.lit(name).alias("tier")).alias("a"))
        found = part if found is None else found.unionAll(part)
    best = found.groupBy(*keys).agg(F.min("a").alias("a"))
    return asked.select(*keys).distinct().join(best, keys).select(*keys, "a.answer", "a.tier")


def file_units(files: DataFrame, by_file: DataFrame, by_dir: DataFrame) -> DataFrame:
    """files (file) -> unit, by the exact file, else by its directory."""
    d = files.withColumn("dir", F.regexp_replace("file", "/[^/]*$", ""))
    return d.join(by_file, "file", "left").join(by_dir.withColumnRenamed("unit", "dir_unit"), "dir", "left").select("file", F.coalesce("unit", "dir_unit").alias("unit"))


def unimported(packages: DataFrame, imported: DataFrame, own: str, prefix: str, limit: int = 5) -> DataFrame:
    """The first names with a prefix, case and all, among packages that aren't imported."""
    return packages.where(F.col("name").startswith(prefix) & (F.col("pkg_path") != own)).join(imported.select("pkg_path"), "pkg_path", "left_anti").orderBy("name", "pkg_path").limit(limit)


def exact_names(names: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (name) -> the entries of exactly that name, case and all."""
    return names.join(asked.select("name").distinct(), "name")


def collisions(strings: DataFrame) -> DataFrame:
    """strings (id_hash, symbol_id) -> hashes that stand for more than one string: (id_hash, n)."""
    return strings.groupBy("id_hash").agg(F.count_distinct("symbol_id").alias("n")).where("n > 1")


def symbol_info(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """ids (symbol_id), of the form package#object -> (symbol_id, pkg, object, ...symbol); unknown ids are dropped."""
    cut = ids.select("symbol_id", F.substring_index("symbol_id", "#", 1).alias("pkg"), F.regexp_replace("symbol_id", "^[^#]*#", "").alias("object"))
    return cut.join(symbols, ["pkg", "object"])
