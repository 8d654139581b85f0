"""The inverted index of occurrences: build, replace, look up, locations, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = ["file", "line", "col", "end_col"]


def build(occurrences: DataFrame) -> DataFrame:
    """One record for a target and source unit, with its locations in order."""
    return occurrences.groupBy("target_pkg", "target_id", "src").agg(F.sort_array(F.collect_list(F.struct(*LOCATION))).alias("locations"))


def record_bytes(file: Column) -> Column:
    """Of a grouped record: 4, and for each location 16 and its file's bytes."""
    return (F.lit(4) + F.sum(F.lit(16) + F.octet_length(file))).cast("long")


def replace(index: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Everything that the given source units wrote goes, what they write now comes; others stay."""
    return index.join(sources.select("src"), "src", "left_anti").unionByName(fresh.join(sources.select("src"), "src", "left_semi"))


def lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (target_pkg, target_id, ...) with the records of the built index (src, locations), nulls where there is none."""
    return wanted.join(index, ["target_pkg", "target_id"], "left")


def promoted(fields: DataFrame, index: DataFrame, on: tuple = ("file", "line", "col")) -> DataFrame:
    """fields (id_hash, place): those that embed a type, that is, whose declared place is a place of another symbol in
    the index; a rename of that type has to rename the field too. (id_hash, target_id, src, file, line, col)."""
    at = index.select("target_id", "src", "file", "line", "col")
    return fields.select("id_hash", *on).join(at, list(on)).where("target_id != id_hash").select("id_hash", "target_id", "src", "file", "line", "col")


def locations(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (query_id, target_pkg, target_id) -> distinct locations."""
    return dedupe(wanted.join(index, ["target_pkg", "target_id"]).select("query_id", *LOCATION), ["query_id"])


def dedupe(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.dropDuplicates([*(keys or []), *LOCATION])


def rename_edits(places: DataFrame, new_text: Column) -> DataFrame:
    """By file: the edits in order."""
    return places.groupBy("query_id", "file").agg(F.sort_array(F.collect_list(F.struct("line", "col", "end_col", new_text.alias("new_text")))).alias("edits"))
