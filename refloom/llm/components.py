"""Connected components of a link table, distributed: alternating large-star and small-star rounds.

Each round keeps at most as many links as before and writes them to the shared folder; a vertex with very
many links is a skewed key of a plain sort-merge join, which adaptive execution splits. The loop ends when
a round changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import discard, materialize


ROWS = 200_000  #: links of a task


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame, tasks: int) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(_minima(both).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "low")
    out = materialize(both.join(low.hint("merge"), "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "large")
    discard(low)
    return out


def _small_star(e: DataFrame, tasks: int) -> DataFrame:
    """e has u > v throughout."""
    low = materialize(_minima(e).coalesce(tasks), "low")
    linked = e.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(linked.unionAll(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "small")
    discard(low)
    return out


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(u, v) links of ids -> (id, root): every linked id and the smallest id that it reaches."""
    e = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(e)
    for _ in range(most):
        if not mark[0]:
            break
        tasks = max(1, -(-mark[0] // ROWS))
        a = _large_star(e, tasks)
        b = _small_star(a, tasks)
        discard(e, a)
        e, before = b, mark
        mark = _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point within {most} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
