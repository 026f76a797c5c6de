"""Truncated singular vectors of sparse term rows, by randomised subspace iteration (Halko, Martinsson and Tropp, 2011).

A matrix is a table of rows (key, cols array<int>, weights array<double>); its columns are terms, of which there are as many as a vocabulary has.
The rows never leave their tasks: each step sums A'(A Q) over them, a slice of Q's columns at a time, so that a task holds a slice
of bounded size. Q itself is a table of blocks in the shared folder, which must be one that pyarrow can open. The driver
sees only matrices of (k + oversampling) squared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.sources import scratch

from .positions import numbered
from .sums import added, packed

#: Columns of A in one block of Q, bytes of a slice that a task holds, and rows of A worked on at once.
BLOCK, SLICE_BYTES, BATCH = 1024, 64 << 20, 2048


def columns_of(vocabulary: DataFrame) -> DataFrame:
    """vocabulary with col: a number for each term from 0."""
    return numbered(vocabulary, "term", "col").withColumn("col", F.col("col").cast("int"))


def side_by_side(blocks: list[tuple[DataFrame, DataFrame]], key: str) -> tuple[DataFrame, int]:
    """(rows, number of columns): term weights (key, term, weight) of several vocabularies as one sparse matrix, the second block's columns
    after the first's and so on. A key that a block lacks has zeros there; a key that all lack has no row. A row holds a value for each of
    its terms, at most as many as there are columns."""
    start, parts = 0, []
    for weights, vocabulary in blocks:
        numbers = columns_of(vocabulary.select("term"))
        parts.append(weights.join(numbers, "term").select(key, (F.col("col") + start).cast("int").alias("col"), "weight"))
        start += vocabulary.count()
    long = parts[0]
    for other in parts[1:]:
        long = long.unionByName(other)
    whole = long.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct("col", "weight"))).alias("e"))
    return whole.select("key", F.col("e.col").alias("cols"), F.col("e.weight").alias("weights")), start


def gaussian(first: int, n: int, width: int, seed: int) -> np.ndarray:
    """n by width standard normal numbers for the columns from `first` on: a function of the block and the seed alone."""
    return np.random.default_rng([seed, first]).standard_normal((n, width))


class Basis:
    """Q: n_cols by width, as a table (slice, first, values) of blocks in a folder; a slice is a run of Q's columns."""

    def __init__(self, path: str, n_cols: int, width: int):
        self.path, self.n_cols, self.width = path, n_cols, width
        self.step = max(1, min(width, SLICE_BYTES // (8 * max(n_cols, 1))))

    @property
    def slices(self) -> list[tuple[int, int]]:
        return [(a, min(a + self.step, self.width)) for a in range(0, self.width, self.step)]

    def read(self, number: int) -> np.ndarray:
        """A slice, in a task."""
        lo, hi = self.slices[number]
        out = np.zeros((self.n_cols, hi - lo))
        store, base = pafs.FileSystem.from_uri(self.path)
        for batch in pads.dataset(base, filesystem=store, format="parquet", partitioning="hive", exclude_invalid_files=True).to_batches(filter=pads.field("slice") == number, columns=["first", "values"]):
            for first, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(values).reshape(-1, hi - lo)
                out[first : first + len(block)] = block
        return out


def _sparse(batches: Iterator[pa.RecordBatch], places: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, row starts, columns, weights) of BATCH rows at most."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            cols, weights = batch.column(places[0]), batch.column(places[1])
            starts = np.zeros(batch.num_rows + 1, dtype=np.int64)
            np.cumsum(cols.value_lengths().fill_null(0).to_numpy(), out=starts[1:])
            yield batch, starts, cols.flatten().to_numpy(), weights.flatten().to_numpy()


def _times(starts: np.ndarray, cols: np.ndarray, weights: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows times q, a row at a time, so that only one row's part of q is copied; a row without values gives zeros."""
    out = np.zeros((len(starts) - 1, q.shape[1]))
    for i, (a, b) in enumerate(pairwise(starts.tolist())):
        np.dot(weights[a:b], q[cols[a:b]], out=out[i])
    return out


def _normal_product(rows: DataFrame, basis: Basis, number: int) -> DataFrame:
    """A'(A Q) for one slice of Q: first, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out = None, None
        for _, starts, cols, weights in _sparse(batches, (0, 1)):
            if q is None:
                q = basis.read(number)
                out = np.zeros_like(q)
            for y, (a, b) in zip(_times(starts, cols, weights, q), pairwise(starts.tolist()), strict=True):
                out[cols[a:b]] += np.multiply.outer(weights[a:b], y)  # a row has a column once
        if out is not None:
            for first in range(0, len(out), BLOCK):
                if out[first : first + BLOCK].any():
                    yield packed(first, out[first : first + BLOCK])

    return added(rows.select("cols", "weights").mapInArrow(run, "key int, values binary")).withColumnRenamed("key", "first")


def _whole_blocks(table: DataFrame, basis: Basis, fn, schema: str) -> DataFrame:
    """fn(first, all of Q's columns of a block) for each block; a block that no row touches is left out."""
    slices, n_cols = basis.slices, basis.n_cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            at, made = None, None
            for batch in batches:
                for number, first, values in zip(*(batch.column(c).to_pylist() for c in ("slice", "first", "values")), strict=True):
                    if first != at:
                        if at is not None:
                            yield at, made
                        at, made = first, np.zeros((min(BLOCK, n_cols - first), slices[-1][1]))
                    lo, hi = slices[number]
                    made[:, lo:hi] = np.frombuffer(values).reshape(-1, hi - lo)
            if at is not None:
                yield at, made

        yield from fn(blocks())

    return table.repartition("first").sortWithinPartitions("first", "slice").mapInArrow(run, schema)


def _orthonormal(spark, table: DataFrame, basis: Basis) -> Basis:
    """An orthonormal basis of the columns of a table (slice, first, values): QR of blocks, then of their triangles; directions that vanish go."""

    def triangle(blocks):
        r = np.zeros((0, basis.width))
        for _, block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    parts = _whole_blocks(table, basis, triangle, "r binary").collect()  # width squared each
    r = np.vstack([np.zeros((0, basis.width)), *[np.frombuffer(bytes(x[0])).reshape(-1, basis.width) for x in parts]])
    _, s, vt = np.linalg.svd(np.linalg.qr(r, mode="r") if len(r) else r, full_matrices=False)
    kept = s > (s[0] if len(s) else 0) * 1e-12
    turn = vt[kept].T / s[kept]
    out = Basis(scratch.path(spark, "basis"), basis.n_cols, int(kept.sum()))
    slices = out.slices

    def turned(blocks):
        for first, block in blocks:
            made = block @ turn
            for number, (lo, hi) in enumerate(slices):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([first], pa.int32()), pa.array([np.ascontiguousarray(made[:, lo:hi]).tobytes()], pa.binary())], names=["slice", "first", "values"])

    if out.width:
        _whole_blocks(table, basis, turned, "slice int, first int, values binary").write.partitionBy("slice").parquet(out.path)
    return out


def _stored(spark, tables: list[DataFrame], basis: Basis, name: str) -> DataFrame:
    path = scratch.path(spark, name)
    for number, table in enumerate(tables):
        table.withColumn("slice", F.lit(number)).write.mode("append").partitionBy("slice").parquet(path)
    return spark.read.schema("first int, values binary, slice int").parquet(path)


def _gram(rows: DataFrame, basis: Basis) -> np.ndarray:
    """(A Q)'(A Q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.width, basis.width))
        for y in (y for _, y in _projected(batches, basis, (0, 1))):
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = rows.select("cols", "weights").mapInArrow(run, "g binary")
    total = np.zeros((basis.width, basis.width))
    for x in parts.toLocalIterator():  # one task's at a time
        total += np.frombuffer(bytes(x[0])).reshape(total.shape)
    return total


def _projected(batches: Iterator[pa.RecordBatch], basis: Basis, places: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    held = None
    for batch, starts, cols, weights in _sparse(batches, places):
        y = np.zeros((batch.num_rows, basis.width))
        for number, (lo, hi) in enumerate(basis.slices):
            if held is None or held[0] != number:
                held = number, basis.read(number)
            y[:, lo:hi] = _times(starts, cols, weights, held[1])
        yield batch, y


class TruncatedSvd:
    """The k greatest singular values and right vectors of the rows it is fitted on; transform gives rows times vectors.

    Rows aren't centred. k, the number of power iterations and the oversampling are parameters; a matrix of lower rank gives fewer values.
    Each vector's sign is that which makes its largest component positive. No rows, or only empty ones, give no values and empty
    projections."""

    def __init__(self, k: int, iterations: int = 7, oversampling: int = 32, seed: int = 42):
        self.k, self.iterations, self.oversampling, self.seed = k, iterations, oversampling, seed

    def fit(self, rows: DataFrame, n_cols: int) -> "TruncatedSvd":
        spark = rows.sparkSession
        n_rows = rows.count()
        width = min(self.k + self.oversampling, n_rows, n_cols)
        self.values, self.vectors = np.zeros(0), Basis("", n_cols, 0)
        if not width:
            return self
        start = Basis(scratch.path(spark, "sketch"), n_cols, width)
        slices, seed = start.slices, self.seed

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    made = gaussian(at, min(BLOCK, n_cols - at), width, seed)
                    for number, (lo, hi) in enumerate(slices):
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([at], pa.int32()), pa.array([np.ascontiguousarray(made[:, lo:hi]).tobytes()], pa.binary())], names=["slice", "first", "values"])

        spark.range(0, n_cols, BLOCK).mapInArrow(sketch, "slice int, first int, values binary").write.partitionBy("slice").parquet(start.path)
        basis = start
        for _ in range(self.iterations + 1):
            product = _stored(spark, [_normal_product(rows, basis, i) for i in range(len(basis.slices))], basis, "product")
            basis = _orthonormal(spark, product, basis)
            if not basis.width:
                return self
        # once more, as blocks' triangles leave a trace of what wasn't orthogonal
        basis = _orthonormal(spark, spark.read.schema("first int, values binary, slice int").parquet(basis.path), basis)
        square, turn = np.linalg.eigh(_gram(rows, basis))
        order = np.argsort(-square)[: self.k]
        order = order[square[order] > square.max() * 1e-14]
        self.values = np.sqrt(square[order])
        self.vectors = self._turned(spark, basis, turn[:, order])
        return self

    def _turned(self, spark, basis: Basis, turn: np.ndarray) -> Basis:
        table = spark.read.schema("first int, values binary, slice int").parquet(basis.path)

        def largest(blocks):
            top = np.zeros(turn.shape[1])
            for _, block in blocks:
                made = block @ turn
                own = made[np.abs(made).argmax(axis=0), np.arange(made.shape[1])]
                top = np.where(np.abs(own) > np.abs(top), own, top)
            yield pa.RecordBatch.from_arrays([pa.array([top.tobytes()], pa.binary())], names=["top"])

        tops = np.array([np.frombuffer(bytes(x[0])) for x in _whole_blocks(table, basis, largest, "top binary").collect()])
        sign = np.sign(tops[np.abs(tops).argmax(axis=0), np.arange(turn.shape[1])])
        turn = turn * np.where(sign == 0, 1, sign)
        out = Basis(scratch.path(spark, "vectors"), basis.n_cols, turn.shape[1])
        slices = out.slices

        def turned(blocks):
            for first, block in blocks:
                made = block @ turn
                for number, (lo, hi) in enumerate(slices):
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([first], pa.int32()), pa.array([np.ascontiguousarray(made[:, lo:hi]).tobytes()], pa.binary())], names=["slice", "first", "values"])

        _whole_blocks(table, basis, turned, "slice int, first int, values binary").write.partitionBy("slice").parquet(out.path)
        return out

    def transform(self, rows: DataFrame, out: str = "vector") -> DataFrame:
        """key, out: k numbers for each row."""
        vectors, kind = self.vectors, rows.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, y in _projected(batches, vectors, (1, 2)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["key", out])

        return rows.select("key", "cols", "weights").mapInArrow(run, f"key {kind}, {out} array<double>")
