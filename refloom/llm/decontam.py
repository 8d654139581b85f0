"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame operations only.

Short items are sought inside long documents: an item is found in a document that holds PERCENT per cent
of the item's distinct word shingles, however long the document is. Items are partitioned by the size of
their sets (powers of two). An item's sketch is the set of its shingles with the smallest hashes, one
more than twice as many as it may lose; a document that contains the item must hold all but the loss of
them, so the search misses nothing. A partition's bound is the largest hash of its sketches: a document's
shingle above the bounds of all partitions that its size allows is dropped before the lookup. An item of fewer
than SHINGLE words is one shingle, all its words; items of each such number of words are a partition of their
own, whose documents are looked up by runs of as many words. Documents that hold enough of a sketch are verified
on the whole sets of shingles, as text.

The sketches are looked up by a broadcast join if they are measured to be small, else by a shuffled one; so are the
items' shingles at the verification. There, a candidate's shingles meet those of the items by text and
are counted for each pair, so no list of items or shingles is collected into a row.

Edge cases: A-Z are lower-cased, words end at ASCII white space; items and documents without words match
nothing, null texts likewise; rows with one id are looked at on their own and the best row of a pair counts; so do
items with one id; documents without an id are sought through, and their pairs have none; extra columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import few, materialize, small

SHINGLE = 5
PERCENT = 80
# The letters that are lower-cased, and the white space that ends words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SPACES), lambda w: w != "")


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """Distinct shingles as text; none if there are fewer words."""
    return F.when(F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " ")))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles in order, repeats included; none if there are fewer words."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))


def allowed_loss(n: Column, percent: int) -> Column:
    """How many of n shingles a match may lack."""
    return n - F.ceil(n * percent / 100)


def item_rows(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """items (item_id, text) -> (item, item_id, width, s): each different text of an item with its shingles; width is the
    number of words of a shingle, fewer than `size` in shorter items. `item` is the number of the text."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    short = F.array(F.array_join("w", " "))
    return w.select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.least(F.size("w"), F.lit(size)).alias("width"), F.when(F.size("w") < size, short).otherwise(shingles(F.col("w"), size)).alias("s"))


def item_sketches(rows: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """rows of item_rows() -> (item, width, n, need, bucket, token): one row for each token of each sketch.
    `need` of the sketch's tokens must be in a document."""
    part = lambda x, k: F.xxhash64(*[F.get(F.split(x, " "), F.lit(j)) for j in range(k)])
    token = lambda x: F.coalesce(*[F.when(F.col("width") == k, part(x, k)) for k in range(1, size + 1)])
    n = F.size("s")
    base = rows.select("item", "width", n.alias("n"), allowed_loss(n, percent).alias("loss"), F.sort_array(F.array_distinct(F.transform("s", token))).alias("h"))
    base = base.withColumn("k", F.least(2 * F.col("loss") + 1, F.size("h")))
    return base.select("item", "width", "n", (F.col("k") - F.col("loss")).alias("need"), F.floor(F.log2("n")).cast("int").alias("bucket"), F.explode_outer(F.slice("h", F.lit(1), F.col("k"))).alias("token")).where("token IS NOT NULL")


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, size: int = SHINGLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item_id, doc_id, n_item, n_shared, containment): every pair at or above the threshold."""
    found = _found(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text}` AS text"), items, percent, size)
    best = found.groupBy("item_id", "doc_id").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("c"), "n", "shared")).alias("b"))
    return best.select("item_id", "doc_id", F.col("b.n").cast("long").alias("n_item"), F.col("b.shared").cast("long").alias("n_shared"), F.col("b.c").alias("containment"))


def _found(docs: DataFrame, items: DataFrame, percent: int, size: int) -> DataFrame:
    """(row, doc_id, item_id, n, shared): `row` is a number of the document's text."""
    docs = docs.where("text IS NOT NULL")
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    rows = materialize(item_rows(few(items, items.count(), 20_000), size), "items")
    sk = materialize(item_sketches(rows, percent, size), "sketches")
    # the bound of a partition, and of all partitions up to it: a document of size n may hold items of size n * 100 / percent
    bounds = sk.groupBy("width", "bucket").agg(F.max("token").alias("bound")).orderBy("width", "bucket").collect()  # at most 31 rows, and size - 1
    top, steps = None, []
    for r in bounds:
        if r["width"] == size:
            top = r["bound"] if top is None else max(top, r["bound"])
            steps.append((r["bucket"], top))
    limit, m = F.lit(None).cast("long"), F.size("w") - (size - 1)
    for bucket, bound in steps:
        limit = F.when(m * 100.0 / percent >= float(2**bucket), F.lit(bound)).otherwise(limit)
    # explode_outer: a filter that is inferred from a plain explode would repeat the array's expression below it
    row = F.xxhash64("doc_id", "text").alias("row")
    hashed = docs.select(row, words(F.col("text")).alias("w")).select("row", shingle_hashes(F.col("w"), size).alias("h"), limit.alias("limit"), "w")
    tokens = hashed.select("row", "limit", F.explode_outer("h").alias("token")).where("token <= limit").select("row", "token")
    for r in bounds:  # one pass for each width that short items have
        if r["width"] < size:
            short = hashed.select("row", F.explode_outer(shingle_hashes(F.col("w"), r["width"])).alias("token"))
            tokens = tokens.unionAll(short.where(F.col("token") <= F.lit(r["bound"])))
    hits = tokens.join(small(sk.select("item", "need", "token")), "token").groupBy("row", "item", "need").agg(F.count_distinct("token").alias("hit")).where("hit >= need")
    pairs = materialize(hits.select("row", "item").distinct(), "pairs")
    # verification: the shingles of candidate documents, of the widths that are wanted, meet those of the items as text
    near = docs.select(row, "doc_id", "text").join(small(pairs.select("row").distinct()), "row", "left_semi").select("row", "doc_id", words(F.col("text")).alias("w"))
    widths = sorted({r["width"] for r in bounds})
    grams = F.array_distinct(F.flatten(F.array(*[shingles(F.col("w"), k) for k in widths]))) if widths else F.array().cast("array<string>")
    each = near.select("row", "doc_id", F.explode_outer(grams).alias("s")).where("s IS NOT NULL").distinct()
    want = small(rows.select("item", "item_id", F.size("s").alias("n"), F.explode_outer("s").alias("s")))
    shared = each.join(want, "s").groupBy("row", "doc_id", "item", "item_id", "n").agg(F.count("*").alias("shared"))
    out = shared.where(F.col("shared") * 100 >= F.col("n") * percent)
    return out.join(pairs.hint("merge"), ["row", "item"], "left_semi")


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows that hold no item; all columns are kept. A row goes for its own text, whatever else has its id."""
    own = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = materialize(_found(docs.select("doc_id", "text"), items, percent, size).select(F.col("row").alias("_row")).distinct(), "leaks")
    return own.join(found, "_row", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT row_number() OVER () AS r, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), k AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ds AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d JOIN k ON len(w) >= k)
), s AS (
  SELECT DISTINCT r, item_id, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT r, item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS j FROM i WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n_item FROM s GROUP BY ALL),
m AS (SELECT item_id, doc_id, s.r AS ir, ds.r AS dr, count(*) AS n_shared FROM s JOIN ds USING (s) GROUP BY ALL)
SELECT m.item_id, doc_id, b.n AS n_item, b.shared AS n_shared, b.c AS containment FROM (
  SELECT m.item_id, doc_id, max({'c': n_shared / n_item, 'n': n_item, 'shared': n_shared}) AS b FROM m JOIN n ON m.ir = n.r WHERE n_shared * 100 >= n_item * 80 GROUP BY ALL) m
"""
