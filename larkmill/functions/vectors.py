"""Array-of-number columns as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def or_zero(v: Column, size: int) -> Column:
    return F.coalesce(v.cast("array<double>"), F.array_repeat(F.lit(0.0), size))


def missing(v: Column) -> Column:
    return v.isNull().cast("int")


def spread(v: str, prefix: str, size: int, digits: int = 4) -> list[Column]:
    """A column for each place; only for files that must be wide."""
    return [F.get(F.col(v), F.lit(i)).alias(f"{prefix}_{i:0{digits}d}") for i in range(size)]


def pooled(tokens: Column, mask: Column, size: int) -> Column:
    """Mean of the token vectors whose mask is 1; divided by 1e-9 at least, so none gives zeros."""
    zero = F.array_repeat(F.lit(0.0), size)
    pairs = F.arrays_zip(tokens.alias("v"), mask.alias("m"))
    total = F.aggregate(pairs, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double") * x["m"].cast("double")))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def padded(ids: Column, size: Column, pad: int = 0) -> Column:
    """Right-padded to size."""
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(0), size - F.size(ids)).cast("int")))


def training_labels(ids: Column, pad: int, vocabulary: int) -> Column:
    return F.transform(ids, lambda x: F.when((x == pad) | (x >= vocabulary), -100).otherwise(x))


def grid_matches(grid: Column, patches: Column) -> Column:
    return F.aggregate(grid, F.lit(1).cast("long"), lambda s, x: s * x) == patches


def standardised(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Mean 0 and population variance 1; a constant column gives 0. Statistics are one row, joined as literals by a broadcast."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = [F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))).otherwise(0.0).alias(c) for c in columns]
    return out.select(key, *scaled)
