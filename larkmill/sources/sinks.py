"""Sinks: CSV, Parquet with swap, chosen formats, appends, chat lines with counters, sample shards, run reports."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import store


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_any(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = True) -> None:
    """Without overwrite, what is there stays."""
    if fmt == "csv":
        write_csv(df, path, "overwrite" if overwrite else "ignore")
    else:
        df.write.mode("overwrite" if overwrite else "ignore").format(fmt).save(path)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Overwrite a table that df itself may read: written whole beside it, then the old one steps aside and the new one takes its name. Whatever is lost in
    between, one of the two is whole on disk; `recovered` (called first here) puts it back."""
    spark, path = df.sparkSession, path.rstrip("/")
    recovered(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    if store.exists(spark, path):
        store.rename(spark, path, old)
    store.rename(spark, new, path)
    if store.exists(spark, old):
        store.delete(spark, old)


def recovered(spark: SparkSession, path: str) -> bool:
    """After a swap that didn't end: a table that isn't there comes back as its finished successor, else as it was; True where that was done.
    What such a swap left beside a table that is there goes."""
    folder, _, name = path.rstrip("/").rpartition("/")
    left = {mark: [x for x in store.names(spark, folder) if x.startswith(f"{name}.{mark}-")] for mark in ("new", "old")}
    lost = not store.exists(spark, path)
    if lost:
        ready = [x for x in left["new"] if store.exists(spark, f"{folder}/{x}/_SUCCESS")]
        back = [*(ready if left["old"] else []), *left["old"]]
        if not back:
            return False
        store.rename(spark, f"{folder}/{back[0]}", path)
    for x in (*left["new"], *left["old"]):
        if store.exists(spark, f"{folder}/{x}"):
            store.delete(spark, f"{folder}/{x}")
    return lost


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, "append")


def write_chat_lines(df: DataFrame, path: str, line: str = "line", keep: str = "keep") -> dict[str, int]:
    """JSON lines of the rows marked `keep`; counts what was written and skipped while writing."""
    seen = Observation()
    counted = df.observe(seen, F.coalesce(F.sum(F.col(keep).cast("long")), F.lit(0)).alias("written"), F.coalesce(F.sum((~F.col(keep)).cast("long")), F.lit(0)).alias("skipped"))
    counted.where(F.col(keep)).select(F.col(line).alias("value")).write.mode("overwrite").text(path)
    return {k: int(v) for k, v in seen.get.items()}


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder for each shard number."""
    df.write.mode("overwrite").partitionBy(shard).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One row as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def _put(at: pafs.FileSystem, name: str, content: bytes) -> None:
    """Written beside its place and moved there, so that a task run again leaves whole files only."""
    temp = f"{name}.{uuid.uuid4().hex}.part"
    with at.open_output_stream(temp) as f:
        f.write(content)
    at.move(temp, name)


def write_npz(df: DataFrame, path: str, key: str = "sample_id", vector: str = "embedding", rows: int = 65_536, overwrite: bool = False) -> bool:
    """Compressed .npz files of at most `rows` keys and vectors, which stay side by side; vectors of one file have one length. Without
    overwrite, a folder that is there stays as it is, and the result is False. The folder must be one that pyarrow opens."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        if not overwrite:
            return False
        fs.delete(target, True)
    fs.mkdirs(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = pafs.FileSystem.from_uri(path)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                made = io.BytesIO()
                vectors = np.array(some.column(1).to_pylist(), dtype=np.float32)
                np.savez_compressed(made, sample_id=some.column(0).to_numpy(zero_copy_only=False).astype(np.int64), embedding=vectors)
                _put(files, f"{base}/part-{part:06d}-{seq:06d}.npz", made.getvalue())
                seq += 1
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64())], names=["files"])

    df.select(key, vector).mapInArrow(run, "files long").agg(F.sum("files")).collect()
    return True


def write_samples(df: DataFrame, path: str, key: str, values: str, shape: tuple[int, ...], meta: list[str]) -> DataFrame:
    """key.npy (float32, of this shape) and key.json (the columns in `meta`) for each row; returns key, bytes of what was written. Meant
    for exchange with tools that want a file for each sample; within this engine a Parquet table holds the same in few files."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            keys, sizes = [], []
            for k, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                made = io.BytesIO()
                np.save(made, np.array(own, dtype=np.float32).reshape(shape))
                about = json.dumps(json.loads(text) | {"shape": list(shape)}).encode()
                _put(files, f"{base}/{k}.npy", made.getvalue())
                _put(files, f"{base}/{k}.json", about)
                keys.append(str(k))
                sizes.append(len(made.getvalue()) + len(about))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], names=["key", "bytes"])

    return df.select(F.col(key), F.col(values), F.to_json(F.struct(*meta))).mapInArrow(run, "key string, bytes long")
