"""Incremental extraction: micro-batches are transformed and appended; a reader keeps each key's last row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.operators.relate import keep_last


def append_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """Run all that is there through `transform` and append it. A batch is written under its own number, so that a batch run again
    after a failure replaces its rows instead of doubling them."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def compacted(spark: SparkSession, out: str, key: str, order: str) -> DataFrame:
    """Each key's last row by batch, then by `order`."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
    return keep_last(rows, key, [F.col("seq"), F.col(order)]).drop("seq")


def skipping_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """JSON lines as a stream, a few files a batch; malformed lines are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(folder)
