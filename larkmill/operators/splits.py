"""Deterministic splits by an arithmetic hash of the key: the same rows in any session and any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(key: Column, n: int) -> Column:
    """0 to n - 1 by a multiplicative hash's upper bits."""
    return F.pmod(F.floor(F.pmod(key.cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(20,0)"), F.lit(4294967296).cast("decimal(20,0)")) / 65536).cast("long"), F.lit(n)).cast("int")


def folded(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", bucket(F.col(key), k))


def split(df: DataFrame, key: str, shares: dict[str, int]) -> DataFrame:
    """A `split` column: names by shares in percent, in their order."""
    b, at, out = bucket(F.col(key), 100), 0, F
    for name, share in shares.items():
        at += share
        out = out.when(b < at, F.lit(name))
    return df.withColumn("split", out)


def hash_order(key: Column) -> Column:
    return bucket(key, 65536)


def disjoint_samples(df: DataFrame, key: str, n_first: int, n_second: int) -> tuple[DataFrame, DataFrame]:
    """Two samples of rows, disjoint, in hash order; sizes are what is asked for."""
    first = df.orderBy(hash_order(F.col(key)), key).limit(n_first)
    rest = df.join(first.select(key), key, "left_anti")
    return first, rest.orderBy(hash_order(F.col(key)), key).limit(n_second)


def sharded(df: DataFrame, key: str, size: int = 1000, ranges: int = 64) -> DataFrame:
    """A `shard` number: consecutive runs of `size` rows by ascending key. Ranks come from counts of key ranges plus ranks within a
    range, so no task orders the whole table."""
    cuts = df.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10000).alias("q")).first()["q"] or []
    number = F.lit(0)
    for c in sorted(set(cuts)):
        number = number + (F.col(key) >= c).cast("int")
    spread = df.withColumn("_range", number)
    counts = spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(key))
    return spread.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("shard", F.floor((F.col("_before") + F.col("_own") - 1) / size).cast("long")).drop("_range", "_own", "_before")
