"""Clusters of vectors: mini-batch k-means over a grid of k, assignment by matrix products, and the Calinski-Harabasz index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.sources import scratch

from .sums import added, packed

#: Rows whose distances are worked out at once, and files of a batch, each a task of a step.
BLOCK, PARTS = 4096, 8


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centre, the lower number on a tie; one matrix product for all rows."""
    square = (centres * centres).sum(axis=1) - 2 * rows @ centres.T
    at = square.argmin(axis=1)
    return at, np.maximum(square[np.arange(len(rows)), at] + (rows * rows).sum(axis=1), 0)


def _stack(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def assign(df: DataFrame, vector: str, centres, out: str = "cluster_id") -> DataFrame:
    """Nearest centre, the lower number on a tie; a null vector has none. The centres travel to the tasks as one matrix: k by the vector's size."""
    table = np.asarray(centres, dtype=float)

    @F.pandas_udf("int")
    def run(vectors: pd.Series) -> pd.Series:
        known = vectors.notna()
        made = pd.Series([None] * len(vectors), dtype="Int32")
        if known.any():
            rows = np.stack([np.asarray(v, dtype=float) for v in vectors[known]])
            made[known.to_numpy()] = np.concatenate([nearest(rows[i : i + BLOCK], table)[0] for i in range(0, len(rows), BLOCK)])
        return made

    return df.withColumn(out, run(F.col(vector)))


def tally(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, dict]:
    """For each model {k: centres}: counts and sums of the rows (one column, vectors) nearest to each centre, sum of squares and of squared
    distances. One pass for all models; tasks hand on sums only."""
    names, width = sorted(models), next(iter(models.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: [np.zeros((len(models[k]), width + 1)), np.zeros(2)] for k in names}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = _stack(batch.column(0).slice(start, BLOCK), width)
                square = (x * x).sum()
                for k in names:
                    at, d = nearest(x, models[k])
                    sums, totals = held[k]
                    order = np.argsort(at, kind="stable")
                    some, first = np.unique(at[order], return_index=True)
                    sums[some, :width] += np.add.reduceat(x[order], first, axis=0)
                    sums[:, width] += np.bincount(at, minlength=len(sums))
                    totals += square, d.sum()
        for k in names:
            yield packed(k, np.concatenate([held[k][0].ravel(), held[k][1]]))

    out = {}
    for r in added(rows.mapInArrow(run, "key int, values binary"), n=len(names)).collect():  # centres of each model
        values = np.frombuffer(bytes(r["values"]))
        sums = values[:-2].reshape(-1, width + 1)
        out[r["key"]] = {"counts": sums[:, width], "sums": sums[:, :width], "square": values[-2], "inertia": values[-1]}
    return out


def plus_plus(sample: np.ndarray, ks: list[int], tries: int, seed: int) -> dict[int, np.ndarray]:
    """Starting centres for every k: the best of some k-means++ draws over a sample. A draw for the greatest k begins with one for each lesser k."""
    best: dict[int, tuple[float, np.ndarray]] = {}
    for t in range(tries):
        rng = np.random.default_rng([seed, t])
        chosen = [int(rng.integers(len(sample)))]
        left = nearest(sample, sample[chosen])[1]
        for k in range(1, max(ks) + 1):
            if k in ks and (k not in best or left.sum() < best[k][0]):
                best[k] = float(left.sum()), sample[chosen]
            if k == max(ks):
                break
            total = left.sum()
            chosen.append(int(rng.choice(len(sample), p=left / total)) if total > 0 else int(rng.integers(len(sample))))
            left = np.minimum(left, nearest(sample, sample[chosen[-1:]])[1])
    return {k: c for k, (_, c) in best.items()}


def fit_mini_batch(df: DataFrame, key: str, vector: str, ks: list[int], seed: int = 42, batch_rows: int = 8192, steps: int = 100, tries: int = 10, patience: int = 10) -> dict[int, np.ndarray]:
    """{k: centres} by mini-batch k-means (Sculley, 2010), all k in the same passes: rows are dealt into batches of about `batch_rows` by a
    hash of the key; a step moves each centre to the mean of all rows that it ever had. A model rests when its smoothed error hasn't fallen for
    `patience` steps.

    Starts are drawn from a sample of three batches at most. Null vectors are left out; fewer rows than k give centres that repeat; no rows
    raise ValueError. A step reads one batch in several tasks; the driver has the centres only."""
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        raise ValueError("no vectors to cluster")
    n_batches = max(1, -(-n // batch_rows))
    used = min(n_batches, steps)
    path = scratch.path(spark, "batches")
    hashed = F.xxhash64(F.lit(seed), key)
    dealt = rows.select("v", F.pmod(hashed, F.lit(n_batches)).cast("int").alias("batch"), F.pmod(F.shiftright(hashed, 32), F.lit(PARTS)).alias("_part")).where(F.col("batch") < used)
    dealt.repartition(min(used * PARTS, 4096), "batch", "_part").drop("_part").write.partitionBy("batch").parquet(path)

    def batch(i: int) -> DataFrame:
        return spark.read.schema("v array<double>").parquet(f"{path}/batch={i % used}")

    seen = spark.read.schema("v array<double>, batch int").parquet(path).where(F.col("batch") < 3)
    sample = np.array([r["v"] for r in seen.select("v").limit(3 * batch_rows).collect()])
    # in one order, whatever file came first
    models = {k: c.copy() for k, c in plus_plus(sample[np.lexsort(sample.T)], ks, tries, seed).items()}
    counts = {k: np.zeros(k) for k in ks}
    smooth: dict[int, float] = {}
    best = {k: (math.inf, 0) for k in ks}
    open_ = set(ks)
    for step in range(steps):
        for k, got in tally(batch(step), {k: models[k] for k in open_}).items():
            size = got["counts"].sum()
            counts[k] += got["counts"]
            moved = got["counts"] > 0
            models[k][moved] += (got["sums"] - got["counts"][:, None] * models[k])[moved] / counts[k][moved][:, None]
            error = got["inertia"] / max(size, 1)
            share = min(1.0, 2 * size / (n + 1))
            smooth[k] = error if k not in smooth else (1 - share) * smooth[k] + share * error
            if smooth[k] < best[k][0] * (1 - 1e-9):
                best[k] = smooth[k], step
            elif step - best[k][1] >= patience:
                open_.discard(k)
        if not open_:
            break
    return models


def fit_kmeans(df: DataFrame, key: str, vector: str, k: int, **settings) -> np.ndarray:
    return fit_mini_batch(df, key, vector, [k], **settings)[k]


def index_scores(df: DataFrame, vector: str, models: dict[int, np.ndarray]) -> dict[int, float]:
    """The Calinski-Harabasz index of the rows under each model: clusters that have rows count; minus infinity under two of them, or where
    there are no more rows than clusters."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    out = {k: -math.inf for k in models}
    for k, got in tally(rows, models).items():
        counts, n = got["counts"], got["counts"].sum()
        full = counts > 0
        if full.sum() < 2 or n <= full.sum():
            continue
        among = ((got["sums"][full] ** 2).sum(axis=1) / counts[full]).sum()
        mean = (got["sums"].sum(axis=0) ** 2).sum() / n
        within = got["square"] - among
        out[k] = math.inf if within <= 1e-12 * max(got["square"], 1e-300) else float((among - mean) / (full.sum() - 1) / (within / (n - full.sum())))
    return out


def cluster_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, n, centre: means by place, from exploded values with partial sums."""
    long = df.select(label, F.posexplode(vector).alias("place", "x"))
    means = long.groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda s: s["m"]).alias("centre"))


def calinski_harabasz(df: DataFrame, vector: str, label: str) -> DataFrame:
    """One row `ch`: between over within dispersion; minus infinity under two labels."""
    long = df.select(label, F.posexplode(vector).alias("place", "x")).withColumn("x", F.col("x").cast("double"))
    per = long.groupBy(label, "place").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    alls = per.groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("q").alias("q"))
    tot = alls.agg(F.sum(F.col("b") - F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("q") - F.col("b")).alias("within"), F.max("n").alias("n"))
    k = df.agg(F.count_distinct(label).alias("k"))
    one = tot.crossJoin(F.broadcast(k))  # one row each
    ch = F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * F.greatest(F.col("k") - 1, F.lit(1)))
    return one.select(F.when(F.col("k") >= 2, ch).otherwise(F.lit(float("-inf"))).alias("ch"))


def best_k(scores: dict[int, float]) -> int:
    """The k of the greatest index, the smaller on a tie."""
    return min(scores, key=lambda k: (-scores[k], k))


def choose_k(df: DataFrame, held: DataFrame, key: str, vector: str, grid: list[int], **settings) -> tuple[int, dict[int, float]]:
    """(best k, index of each): fitted on df in common passes, scored on held rows in one."""
    scores = index_scores(held, vector, fit_mini_batch(df, key, vector, grid, **settings))
    return best_k(scores), scores


def resolve_k(explicit: int | None = None, selected: int | None = None, default: int = 500) -> int:
    """The number of clusters: what the caller says, else what a selection found, else the default."""
    k = next(k for k in (explicit, selected, default) if k is not None)
    if k < 1:
        raise ValueError(f"{k} clusters")
    return k
