"""Sums of packed number arrays by a whole-number key, in streams: what tasks have gathered is added up without meeting in one list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def packed(key: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())], names=["key", "values"])


def added(parts: DataFrame, kind: str = "<f8", n: int | None = None) -> DataFrame:
    """key, values: one row for each key of parts (key int, values binary of one length a key). Rows are sorted by key within a partition, so a
    task holds one sum at a time. n: partitions, where the keys are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(own, kind)
                if key == at:
                    total += x
                    continue
                if at is not None:
                    yield packed(at, total)
                at, total = key, x.copy()
        if at is not None:
            yield packed(at, total)

    dealt = parts.repartition(n, "key") if n else parts.repartition("key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, "key int, values binary")
