"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes: h = (h << 1) + gear[byte], seen through a window of 16 bytes. A
chunk ends where the hash falls below a bound, so borders depend on the bytes near them alone and an
insertion moves only the chunk that it is in. There is no least length, which would tie a border to the
ones before it. A stretch of more than LONG_CHUNK bytes without a border, as in text that repeats a few words
over and over, is cut at its smallest hashes, so there too the bytes choose the borders. Chunks are compared by digest, 96 bits of it, over the
whole corpus: of the 4e12 chunks of 100 TB fewer than one pair is expected to be equal by chance. A repeated
span is a run of chunks that other documents have too, of SPAN bytes or more.

Plan: texts are cut (one pass of numpy), digests are counted with map-side aggregation and written; texts are cut
again, and the chunks are joined to the counted digests, both sides being plain shuffles so that a digest in a third of all documents
is split by the skew join; a document's repeated chunks meet by document, where window functions find the
runs. Nothing goes to the driver.

Edge cases: null and empty texts have no chunks and no spans, and neither have rows without an id; rows with the same id are one
document and equal ones count once, a chunk repeated only within it isn't a repeated one; equal documents
repeat each other whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import arrow_types, materialize, slices, small, tidy

AVERAGE = 24  #: bytes between borders, on average
LONG_CHUNK = 256  #: bytes of a stretch without a border that is cut at its smallest hashes
SHORT_CUT = 64  #: least bytes between such cuts where the smallest hash repeats
WINDOW = 16
SPAN = 128  #: least bytes of a repeated span, whole chunks
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The rolling hash at each byte, modulo 2^32, over a window that is a power of two: sums of windows
    of 1, 2, 4, ... bytes are doubled."""
    h, w = _GEAR[data], 1
    while w < window:
        h2 = h.copy()
        h2[w:] += h[:-w] << np.uint32(w)
        h, w = h2, 2 * w
    return h


def _smallest(h: np.ndarray, first: int, last: int) -> list[int]:
    """Ends of chunks inside a stretch [first, last) without borders: at the places of its smallest hash, SHORT_CUT
    bytes or more apart, and so on within what is still longer than LONG_CHUNK."""
    out, todo = [], [(first, last)]
    while todo:
        a, b = todo.pop()
        if b - a <= LONG_CHUNK:
            continue
        inside = h[a : b - 1]
        ties, cuts, at = np.flatnonzero(inside == inside.min()) + a + 1, [], 0
        while at < len(ties):
            cuts.append(int(ties[at]))
            at = int(np.searchsorted(ties, ties[at] + SHORT_CUT))
        out += cuts
        todo += zip([a, *cuts], [*cuts, b])
    return out


def borders(data: bytes, average: int = AVERAGE) -> list[int]:
    """Ends of the chunks of data, the last being its length. The bound looks at the top bits that the
    window has filled."""
    if not data:
        return []
    mixed = gear_hashes(np.frombuffer(data, dtype=np.uint8)) * np.uint32(0x9E3779B1)
    ends = np.flatnonzero(mixed < np.uint32((1 << 32) // average)) + 1
    ends = np.r_[ends[ends < len(data)], len(data)]
    begins = np.r_[0, ends[:-1]]
    more = [e for k in np.flatnonzero(ends - begins > LONG_CHUNK).tolist() for e in _smallest(mixed, int(begins[k]), int(ends[k]))]
    return np.sort(np.r_[ends, np.array(more, dtype=ends.dtype)]).tolist()


CHUNK = "doc_id long, part long, place long, digest long, more int"
START, LENGTH = "shiftright(place, 20)", "place & 1048575"  #: what a chunk's place holds, as SQL


def chunks(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(CHUNK): the chunks of every whole text of a row with an id. `place` holds the first byte and the number of bytes,
    the digest 64 bits and `more` another 32. Different texts under one id are told apart by `part`, which is 0 for all
    others."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    h = F.xxhash64("t")
    several = materialize(d.select("i", h.alias("h")).groupBy("i").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("i"), "several")
    if several.limit(1).count():
        d = d.join(small(several.withColumn("several", F.lit(True))), "i", "left").select("i", F.when(F.col("several"), h).otherwise(0).alias("part"), "t")
    else:
        d = d.select("i", F.lit(0).cast("long").alias("part"), "t")
    types, names = arrow_types(docs.sparkSession, CHUNK), [c.split()[0] for c in CHUNK.split(", ")]

    def fill(batches):
        import pyarrow as pa
        import xxhash

        digest, second = xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest

        def batch(cols):
            ids, parts, places, digests, more = cols
            made = [ids, parts, places, np.array(digests, dtype="uint64").view("int64"), np.array(more, dtype="uint32").view("int32")]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(made, types)], names=names)

        for b in (part for whole in batches for part in slices(whole, 2)):
            cols: tuple = ([], [], [], [], [])
            for i, part, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data, s = t.encode(), 0
                ends = borders(data)
                cols[0].extend([i] * len(ends))
                cols[1].extend([part] * len(ends))
                for e in ends:
                    x = data[s:e]
                    cols[2].append(s << 20 | e - s)
                    cols[3].append(digest(x))
                    cols[4].append(second(x))
                    s = e
                if len(cols[0]) > 100_000:
                    yield batch(cols)
                    cols = ([], [], [], [], [])
            yield batch(cols)
        tidy()

    return d.mapInArrow(fill, CHUNK)


def repeated_chunks(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Chunks whose digest occurs in two documents or more, with the smallest of their ids in `first_doc`."""
    all_chunks = chunks(docs, text, id_col)  # cut twice: that takes less than to write them and read them twice
    shared = all_chunks.groupBy("digest", "more").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last")).where("first_doc < _last").drop("_last")
    shared = materialize(shared, "digests")
    return all_chunks.join(shared.hint("merge"), ["digest", "more"])


def repeated_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = SPAN, later: bool = False) -> DataFrame:
    """(doc_id, start, length, n_chunks, first_doc): runs of neighbouring repeated chunks of `least` bytes or
    more, in bytes of the text. A chunk's first document is the smallest id that has it; first_doc is the
    largest one of the run's chunks. With `later`, runs hold only chunks that a smaller id has."""
    found = repeated_chunks(docs, text, id_col)
    found = found.where("first_doc < doc_id") if later else found
    # dealt by document first: rows that are equal and runs are found there, without another shuffle
    rows = found.select("doc_id", "part", "place", "first_doc").repartition("doc_id", "part").distinct()
    rows = rows.withColumns({"start": F.expr(START), "length": F.expr(LENGTH)})
    order = Window.partitionBy("doc_id", "part").orderBy("place")
    breaks = F.when(F.lag(F.col("start") + F.col("length")).over(order) == F.col("start"), 0).otherwise(1)
    runs = rows.withColumn("breaks", breaks).withColumn("run", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "part", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.count("*").alias("n_chunks"), F.max("first_doc").alias("first_doc"))
    return spans.where(F.col("length") >= least).select("doc_id", "start", "length", "n_chunks", "first_doc").distinct()


def dedup_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = SPAN) -> DataFrame:
    """(doc_id, text): every text without the spans that smaller ids have; null stays null, and so does the text of
    a row without an id. A character that a span's border cuts goes."""
    spans = repeated_spans(docs, text, id_col, least, later=True).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("cut"))
    types = arrow_types(docs.sparkSession, "text string")

    def fill(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t is not None and cut is not None:
                    raw, at, keep = t.encode(), 0, []
                    for x in cut:
                        keep.append(raw[at : x["start"]])
                        at = max(at, x["start"] + x["length"])
                    t = b"".join([*keep, raw[at:]]).decode(errors="ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=types[0])], names=["doc_id", "text"])
        tidy()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    return rows.join(spans, F.col("i") == F.col("doc_id"), "left").select("i", "t", "cut").mapInArrow(fill, "doc_id long, text string")
