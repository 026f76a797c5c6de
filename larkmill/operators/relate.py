"""Joins, imputation, deduplication and set operations on one key, safe against clashing names and repeated keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import medians


def join_left(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """base with other's new columns; columns that both have stay base's."""
    return base.join(other.drop(*[c for c in other.columns if c != key and c in base.columns]), key, "left")


def fold_left(frames: list[DataFrame], key: str, leading: str | None = None) -> DataFrame:
    """All frames left-joined onto the first that has the `leading` column (the first of all otherwise); earlier columns win."""
    base = next((f for f in frames if leading in f.columns), frames[0])
    return reduce(lambda a, b: join_left(a, b, key), [f for f in frames if f is not base], base)


def join_one_to_one(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that fails at run time where a key comes twice on either side. The check rides on each side's own grouping."""

    def once(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(key))
        return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))))

    return join_left(once(base), once(other), key)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that every frame has."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), frames[1:], frames[0].select(key).distinct())


def with_median(df: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Nulls filled with the exact median of the same column of `source` (df itself otherwise); a column without values stays null. The medians
    are found by refining ranges when this is called, so that no task has all values."""
    found = medians(source if source is not None else df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(found[c]).cast("double")) for c in columns})


def complete_predictions(wanted: DataFrame, predicted: DataFrame, train: DataFrame, key: str, value: str) -> DataFrame:
    """Every wanted key once: predicted, or the training median."""
    lost = wanted.select(key).join(predicted.select(key), key, "left_anti")
    fill = F.lit(medians(train, [value])[value]).cast("double").alias(value)
    return predicted.select(key, value).unionByName(lost.select(key, fill))


def keep_last(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by a total order."""
    last = W.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") == 1).drop("_rank")


def reindexed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns, of these types, in this order; missing ones null, others gone."""
    return df.select([(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def aligned(df: DataFrame, features: dict[str, object], key: str) -> DataFrame:
    """Features as a model's metadata list them: missing columns and nulls take the default, other columns go."""
    return df.select(key, *[(F.coalesce(F.col(f"`{c}`"), F.lit(d)) if c in df.columns else F.lit(d)).alias(c) for c, d in features.items()])


def known_category(df: DataFrame, column: str, known: DataFrame, other: str = "Unknown") -> DataFrame:
    """Values outside the known list become `other`."""
    mark = known.select(F.col(column).alias("_known")).distinct()
    return df.join(mark, F.col(column) == F.col("_known"), "left").withColumn(column, F.coalesce("_known", F.lit(other))).drop("_known")


def downcast(df: DataFrame) -> DataFrame:
    """double to float, long to int (null beyond its range)."""
    small = {"double": "float", "bigint": "int"}
    return df.select([F.col(f"`{c}`").try_cast(small[t]).alias(c) if t in small else F.col(f"`{c}`") for c, t in df.dtypes])


def prediction_column(df: DataFrame, key: str, choices: list[tuple[str, bool]]) -> DataFrame:
    """key, prediction: the first column of `choices` that df has. Log-scaled ones (marked) are brought back where their least-key
    value is under 15."""
    name, log = next((n, g) for n, g in choices if n in df.columns)
    if not log:
        return df.select(key, F.col(name).alias("prediction"))
    first = df.agg(F.min_by(name, key).alias("_first"))
    out = df.crossJoin(F.broadcast(first))  # one row
    return out.select(key, F.when(F.col("_first") < 15, F.expm1(name)).otherwise(F.col(name)).alias("prediction"))


def dealt(df: DataFrame, key: str, rows: int, n: int | None = None) -> DataFrame:
    """df by key in parts of about `rows` rows. A table of few bytes lies in few files however many rows it has; where each row is made into
    much, or costs much, a task would else have a great share of that. n: the number of rows, where it is known."""
    parts = -(-(df.count() if n is None else n) // rows)
    return df.repartition(parts, key) if parts > 1 else df
