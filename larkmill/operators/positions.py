"""Row numbers without one task for all rows: counts of parts, prefix sums over the parts, places within a part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _before(counts: DataFrame, part: str) -> DataFrame:
    """Rows in all parts that sort before each part; counts has one row a part."""
    running = F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(part, F.coalesce(running, F.lit(0)).alias("_before"))


def numbered(df: DataFrame, column: str, out: str, ranges: int = 256) -> DataFrame:
    """df with 0, 1, 2 ... in `out`, the same for the same values in any session. Rows are dealt into `ranges` by a hash of the column, so
    numbers follow (range, value); equal values get neighbouring numbers in any order."""
    spread = df.withColumn("_range", F.pmod(F.xxhash64(column), F.lit(ranges)))
    before = _before(spread.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), "_range")
    own = F.row_number().over(W.partitionBy("_range").orderBy(column))
    made = spread.withColumn("_own", own).join(F.broadcast(before), "_range")  # a row for each range
    return made.withColumn(out, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_range", "_own", "_before")


def file_positions(spark, path: str, columns: list[str], out: str = "position") -> tuple[DataFrame, int]:
    """(rows of a Parquet path with their position, number of rows): files in the order of their names, rows in the order of a file. No rows move for it:
    only the counts of files are summed."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    made = rows.join(_before(counts, "_file"), "_file")
    return made.select(*columns, (F.col("_before") + F.col("_row")).alias(out)), int(total)


def zipped(spark, left: str, right: str, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """position, left's and right's columns: two Parquet sources without a common key side by side, by position. Unequal lengths raise, as do columns of one
    name; two empty sources give no rows."""
    if both := set(left_columns) & set(right_columns):
        raise ValueError(f"both sides have {sorted(both)}")
    a, n = file_positions(spark, left, left_columns)
    b, m = file_positions(spark, right, right_columns)
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    return a.join(b, "position").select("position", *left_columns, *right_columns)
