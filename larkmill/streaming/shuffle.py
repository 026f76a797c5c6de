"""A shuffle buffer over a stream of rows: what training readers do to shards that are too large to shuffle whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def emitted(n: int, slots: list[int], first: int, size: int, rng: np.random.Generator) -> list[int]:
    """Rows `first` to first + n - 1 arrive one by one: a full buffer hands out a random one of its rows and keeps the new one in its place."""
    out = []
    for row in range(first, first + n):
        if len(slots) < size:
            slots.append(row)
            continue
        at = int(rng.integers(size))
        out.append(slots[at])
        slots[at] = row
    return out


def shuffled(df: DataFrame, size: int = 1000, seed: int = 42) -> DataFrame:
    """df's rows in another order within each partition (a shard of the stream): a row comes out at most size - 1 places early. The order is a function of
    the seed, the partition's number and the order that the rows arrive in; a task holds `size` rows and a batch. All rows come out once; an empty
    table stays empty."""
    if size < 1:
        raise ValueError("a buffer holds a row at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: pa.Table | None = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            n = held.num_rows if held is not None else 0
            both = pa.concat_tables([held, own]) if held is not None else own
            slots = list(range(n))
            out = emitted(own.num_rows, slots, n, size, rng)
            if out:
                yield from both.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
            held = both.take(pa.array(slots, pa.int64())).combine_chunks()
        if held is not None and held.num_rows:
            yield from held.take(pa.array(rng.permutation(held.num_rows))).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)
