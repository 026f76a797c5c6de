"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long links to (node, root): root is the least node reachable; nodes without links don't appear.

    Each round points every node's larger neighbours at its least neighbour, then the other way round, until nothing changes. A
    round's joins and partial aggregates are keyed by node; a hub's rows are only re-labelled, never gathered. Each round is written
    to the shared folder, which cuts the lineage. Null ends and loops are left out; no links give no rows."""
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        moved = large.join(low, F.col("a") == F.col("k")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(moved.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
