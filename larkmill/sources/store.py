"""Small files in any file system that Spark knows: written whole, swapped in one step, listed and deleted by the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where it isn't there."""
    fs, target = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
    finally:
        stream.close()


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Written beside its place, then renamed over what is there: a reader finds the old file or the new one, never a part."""
    jvm = spark.sparkContext._jvm
    temp = f"{path}.{uuid.uuid4().hex}.part"
    fs, target = _fs(spark, temp)
    out = fs.create(target, True)
    try:
        out.write(content)
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    final = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(target), fs.makeQualified(final), options)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, of = _fs(spark, source)
    if not fs.rename(of, _fs(spark, target)[1]):
        raise OSError(f"{source} was not renamed to {target}")
