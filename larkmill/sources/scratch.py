"""The shared folder for intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from . import store


def root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, a temporary one is set in local mode; on a cluster that raises, as executors
    wouldn't see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return named or found.get()
    if not named and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    folder = named or f"file://{tempfile.mkdtemp(prefix='larkmill-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own(spark: SparkSession) -> str:
    return f"larkmill-{spark.sparkContext.applicationId}-"


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark).rstrip('/')}/{_own(spark)}{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession) -> int:
    """Delete what this application has left in the shared folder; returns how many entries. Call it when no lazily read result is needed any more."""
    folder = root(spark).rstrip("/")
    own = [x for x in store.names(spark, folder) if x.startswith(_own(spark))]
    for x in own:
        store.delete(spark, f"{folder}/{x}")
    return len(own)
