"""What the training-data operators share: scratch tables, Arrow batch mapping, ASCII words, doc ranges."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch, and bytes where a table is written; with long texts this, not the row count of a partition, bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, "1m"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none, a temporary one is set in local mode, where all tasks
    run on one machine; on a cluster that raises, as executors wouldn't see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = f"file://{tempfile.mkdtemp(prefix='larkmill-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{_own(spark)}{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"larkmill-{spark.sparkContext.applicationId}-"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing. While it is written, Arrow batches
    hold about BATCH_BYTES, so that few long texts meet in a worker; the session's setting comes back afterwards. Without `compression`
    the session's is taken."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    try:
        spark.conf.set(key, BATCH_BYTES)
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(key, now)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written(), once all that is read from them is written."""
    for table in tables:
        files = table.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        spark = table.sparkSession
        if folder.rsplit("/", 1)[-1].startswith(_own(spark)):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Call it when no lazily read result is needed any more."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(base):
        for entry in fs.listStatus(base):
            if entry.getPath().getName().startswith(_own(spark)):
                fs.delete(entry.getPath(), True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of BATCH_ROWS rows at most. Spark bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB
    unless the session says otherwise); rows are cut here, so that no session setting changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, max(1, b.num_rows), BATCH_ROWS))
        _trim()

    return df.mapInArrow(run, schema)


def _trim() -> None:
    """Give free memory back to the system: Spark keeps workers for the next task, and what they hold counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 65_536, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `rows` rows or `size` bytes, for work that is cheap by the thousand."""
    held, n, nbytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        nbytes += batch.nbytes if size else 0
        if n >= rows or size and nbytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, nbytes = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the fast built-in path."""
    return F.when(F.char_length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of anything but space, \\t, \\n, \\v, \\f, \\r, with A-Z lower-cased; bytes methods do exactly this."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(values: list) -> pa.Array:
    return pa.array(values, type=pa.string())


def range_bounds(ids: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 cut points that deal the ids into n ranges of about equal size. The list's length is n's, not the data's."""
    if n < 2:
        return []
    got = ids.select(F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n).alias("q")).first()
    return sorted(set(got["q"] or []))
