"""Histogram gradient boosting: rows stay binned in a table, each level of a tree is one sum of per-task histograms.

Gradients are summed as fixed-point integers, so a fit gives the same trees whatever the order of the tasks. Monotone features keep their direction in every
tree: a split must not turn it, and the middle of its two values bounds all that is below (the way of the public libraries for constrained trees)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.functions.metrics import iqr_delta
from larkmill.sources import scratch, store

from .quantiles import quantiles, values_at
from .sums import added, packed

#: Steps of the fixed-point sums: 2^26 leaves room for 10^11 rows in 64 bits.
UNIT = float(1 << 26)
#: Rounds after which the predictions so far are written with the rows, so that a pass walks few trees.
STORED = 10
#: Combinations of bins up to which rows of equal bins are summed once, and rounds that are grown from those sums before one pass finds their errors.
CELLS, AHEAD = 1 << 17, 50
#: Cells in one row of their sums.
CELL_BLOCK = 4096


#: Steps of the summed errors.
ERROR_UNIT = float(1 << 20)


def _errors(y: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    if metric == "mae":
        return np.abs(p - y)
    p = np.maximum(p, 0)
    return 100 * np.abs(p - y) / ((np.abs(y) + np.abs(p)) / 2 + 1e-8)


def _grid(width: int, n_features: int) -> np.ndarray:
    """The bins of every cell, in order of their numbers."""
    return np.indices((width,) * n_features).reshape(n_features, -1).T.astype(np.uint8 if width <= 256 else np.uint16)


def _cells(bins: np.ndarray, width: int) -> np.ndarray:
    at = np.zeros(len(bins), dtype=np.int64)
    for own in bins.T:
        at = at * width + own
    return at


class StoppedFit(RuntimeError):
    """A fit that its caller ended; its snapshots are there."""


def monotone_signs(features: list[str], rising: tuple[str, ...] = ("mass", "volume", "pack_count", "mass_g", "volume_ml")) -> list[int]:
    return [int(c in rising) for c in features]


class Tree:
    """Nodes as arrays; a row goes left where its bin is at most the node's."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, at: int, feature: int, bin_: int, values: tuple[float, float]) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[at], self.bin[at], self.left[at], self.right[at] = feature, bin_, left, left + 1
        for v in values:
            for own, x in zip((self.feature, self.bin, self.left, self.right, self.value), (-1, 0, 0, 0, v), strict=True):
                own.append(x)
        return left, left + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), dtype=np.int64)
        while (go := feature[at] >= 0).any():
            rows = np.flatnonzero(go)
            here = at[rows]
            at[rows] = np.where(bins[rows, feature[here]] <= cut[here], left[here], right[here])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    def as_dict(self) -> dict:
        return dict(self.__dict__)

    @staticmethod
    def of(d: dict) -> "Tree":
        made = Tree()
        made.__dict__.update({k: list(v) for k, v in d.items()})
        return made


class Binner:
    """Raw values to bins: 0 is missing; numbers by cuts, categories by their place in a saved list (the one after the last: unseen)."""

    def __init__(self, features: list[str], cuts: dict[str, list[float]], categories: dict[str, list[str]]):
        self.features, self.cuts, self.categories = features, cuts, categories

    @staticmethod
    def fit(df: DataFrame, features: list[str], categorical: list[str], bins: int, most_categories: int = 200) -> "Binner":
        """Cuts at exact quantiles, the same for the same rows in any order (a fit is taken up only where its cuts are the snapshot's); a category
        list keeps the commonest `most_categories` values, ties by name, so the model stays small."""
        numbers = [c for c in features if c not in categorical]
        found = values_at(df, numbers, lambda n: [max(0, -(-i * n // bins) - 1) for i in range(1, bins)]) if numbers else {}
        cuts = {c: sorted({float(x) for x in found[c] if x == x}) for c in numbers}
        lists = {}
        for c in categorical:
            top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            lists[c] = sorted(r["v"] for r in top.orderBy(F.desc("n"), "v").limit(most_categories).collect())
        return Binner(features, cuts, lists)

    @property
    def width(self) -> int:
        return 2 + max([0, *map(len, self.cuts.values()), *map(len, self.categories.values())])

    def bins(self, columns: list[pa.Array]) -> np.ndarray:
        out = np.zeros((len(columns[0]) if columns else 0, len(self.features)), dtype=np.uint8 if self.width <= 256 else np.uint16)
        for j, (name, own) in enumerate(zip(self.features, columns, strict=True)):
            if name in self.categories:
                place = pc.index_in(own, value_set=pa.array(self.categories[name], pa.string()))
                found = place.fill_null(len(self.categories[name])).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                out[:, j] = np.where(own.is_null().to_numpy(zero_copy_only=False), 0, found)
            else:
                x = own.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
                out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(self.cuts[name]), x, side="left"))
        return out

    def inputs(self) -> list[Column]:
        return [F.col(f"`{c}`").cast("string" if c in self.categories else "double").alias(f"f{i}") for i, c in enumerate(self.features)]


class HistogramBooster:
    """Boosted trees under the pseudo-Huber loss ("huber") or the squared one, stopped on held rows.

    features: columns, of which `categorical` ones are text; signs: 1 (predictions never fall as the feature rises), -1 or 0 for each. Missing
    values are lower than all others. metric: "smape" (of predictions not under 0) or "mae". history has the metric after each round, on held
    rows, or the fitted ones where none are held; trees after the best round are dropped. A target that is null leaves its row out; no rows
    raise ValueError."""

    def __init__(self, features: list[str], objective: str = "huber", metric: str = "smape", rate: float = 0.1, rounds: int = 100, depth: int = 4, patience: int = 20, bins: int = 64, l2: float = 1.0, least: int = 1,
                 categorical: tuple[str, ...] = (), signs: list[int] | None = None):
        self.settings = {"features": features, "objective": objective, "metric": metric, "rate": rate, "rounds": rounds, "depth": depth, "patience": patience, "bins": bins, "l2": l2, "least": least,
                         "categorical": list(categorical), "signs": signs or [0] * len(features)}
        self.trees: list[Tree] = []
        self.history: list[float] = []

    # fitting

    def fit(self, df: DataFrame, target: str, held: DataFrame | None = None, snapshots: str | None = None, every: int = 10, keep: int = 3, stop: Callable[[int], bool] | None = None) -> "HistogramBooster":
        """snapshots: a folder where the model is kept every `every` rounds, the last `keep` of them, behind a manifest that is swapped in one
        step; a fit of the same settings goes on from there. stop(round) ends the fit with StoppedFit."""
        spark, s = df.sparkSession, self.settings
        whole = df.withColumn("_held", F.lit(False))
        if held is not None:
            whole = whole.unionByName(held.withColumn("_held", F.lit(True)), allowMissingColumns=True)
        whole = whole.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
        y = F.col(target).cast("double")
        train = whole.where("NOT _held")
        self.binner = Binner.fit(train, s["features"], s["categorical"], s["bins"])
        stats = train.agg(F.avg(y).alias("mean"), F.min(y).alias("least"), F.max(y).alias("most")).first()
        if stats["mean"] is None:
            raise ValueError("no rows to fit")
        low, middle, high = quantiles(train, [target], [0.25, 0.5, 0.75])[target]
        self.start = float(middle if s["objective"] == "huber" else stats["mean"])
        self.delta = iqr_delta([low, high])
        self.bound = self.delta if s["objective"] == "huber" else 4 * max(float(stats["most"] - stats["least"]), 1e-12)
        self.gains = [0.0] * len(s["features"])
        self.uses = [0] * len(s["features"])
        if snapshots:
            self._resume(spark, snapshots)
        table = self._binned(whole, y)
        if s["objective"] == "squared" and self._has_cells():
            return self._fit_by_cells(table, max(float(stats["most"] - stats["least"]), 1e-12), snapshots, every, keep, stop)
        stored = 0
        best = min(range(len(self.history)), key=self.history.__getitem__, default=-1)
        while True:
            # one pass gives the error of the trees so far and the next tree's first histogram
            first, error = self._histograms(table, stored, Tree(), [0])
            n = len(self.trees)
            if n > len(self.history):
                self.history.append(error)
                if best < 0 or error < self.history[best]:
                    best = n - 1
                if snapshots and n % every == 0:
                    self._snapshot(spark, snapshots, keep)
                if stop and stop(n):
                    raise StoppedFit(n)
            if n >= s["rounds"] or best >= 0 and n - 1 - best >= s["patience"]:
                break
            self.trees.append(self._grow(first, lambda tree, nodes: self._histograms(table, stored, tree, nodes)[0]))
            if (n + 1) % STORED == 0:
                table, stored = self._advanced(table, stored), n + 1
        self.best_round = best + 1
        self.trees = self.trees[: self.best_round]
        return self

    def _has_cells(self) -> bool:
        return self.binner.width ** len(self.binner.features) <= CELLS

    def _fit_by_cells(self, table: DataFrame, scale: float, snapshots: str | None, every: int, keep: int, stop: Callable[[int], bool] | None) -> "HistogramBooster":
        """Under the squared loss, a tree is a function of the rows and the sum of targets in each cell (rows of equal bins), so trees grow on
        the driver from one pass's sums, AHEAD of them before a pass over the rows finds the error after each. Trees past the stop go."""
        spark, s = table.sparkSession, self.settings
        rows, targets, any_held = self._cell_sums(table, scale)
        grid = _grid(self.binner.width, len(self.binner.features))
        p = np.full(len(grid), self.start)
        for tree in self.trees:
            p += tree.predict(grid)
        best = min(range(len(self.history)), key=self.history.__getitem__, default=-1)
        done = lambda: len(self.trees) >= s["rounds"] or best >= 0 and len(self.trees) - 1 - best >= s["patience"]
        while not done():
            kept, base, grown = (self.gains, self.uses), p.copy(), []
            for _ in range(min(AHEAD, s["rounds"] - len(self.trees))):
                self.gains, self.uses = [*self.gains], [*self.uses]
                slopes = np.rint((rows * (p - self.start) - targets / UNIT * scale) / self.bound * UNIT)
                histograms = lambda tree, nodes, g=slopes: self._cell_histograms(grid, g, rows, tree, nodes)
                tree = self._grow(histograms(Tree(), [0]), histograms)
                p += tree.predict(grid)
                grown.append((tree, self.gains, self.uses))
            self.gains, self.uses = kept
            errors = self._errors_ahead(table.where("held") if any_held else table, base, [x[0] for x in grown])
            for (tree, self.gains, self.uses), error in zip(grown, errors, strict=True):
                self.trees.append(tree)
                self.history.append(error)
                n = len(self.trees)
                if best < 0 or error < self.history[best]:
                    best = n - 1
                if snapshots and n % every == 0:
                    self._snapshot(spark, snapshots, keep)
                if stop and stop(n):
                    raise StoppedFit(n)
                if done():
                    break
        self.best_round = best + 1
        self.trees = self.trees[: self.best_round]
        return self

    def _cell_sums(self, table: DataFrame, scale: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """(fitted rows, sum of their targets less the start as whole steps of UNIT of scale) by cell; whether there are held rows."""
        width, start, read = self.binner.width, self.start, self._bins
        n_cells = width ** len(self.binner.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, held_rows = np.zeros((n_cells, 2), dtype=np.int64), 0
            for batch in batches:
                held = batch.column(2).to_numpy(zero_copy_only=False)
                at, y = _cells(read(batch.column(0)), width)[~held], batch.column(1).to_numpy()[~held]
                total[:, 0] += np.bincount(at, minlength=n_cells)
                total[:, 1] += np.bincount(at, np.rint((y - start) / scale * UNIT), n_cells).astype(np.int64)
                held_rows += int(held.sum())
            yield packed(-1, np.array([held_rows]))
            for first in range(0, n_cells, CELL_BLOCK):
                if total[first : first + CELL_BLOCK, 0].any():
                    yield packed(first, total[first : first + CELL_BLOCK])

        found = {r["key"]: np.frombuffer(bytes(r["values"]), np.int64) for r in added(table.mapInArrow(run, "key int, values binary"), "<i8").collect()}  # two numbers for each cell
        held_rows = found.pop(-1)[0]
        total = np.zeros((n_cells, 2), dtype=np.int64)
        for first, x in found.items():
            total[first : first + CELL_BLOCK] = x.reshape(-1, 2)
        return total[:, 0], total[:, 1], bool(held_rows)

    def _cell_histograms(self, grid: np.ndarray, slopes: np.ndarray, rows: np.ndarray, tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
        width = self.binner.width
        lookup = np.full(len(tree.feature), -1)
        lookup[nodes] = range(len(nodes))
        own = lookup[tree.nodes(grid)]
        here = np.flatnonzero((own >= 0) & (rows > 0))
        total = np.zeros((len(nodes), grid.shape[1], width, 3), dtype=np.int64)
        for f in range(grid.shape[1]):
            at = own[here] * width + grid[here, f]
            for k, w in ((0, slopes[here]), (2, rows[here])):
                total[:, f, :, k] = np.bincount(at, w, len(nodes) * width).reshape(len(nodes), width)
        total[..., 1] = total[..., 2] * int(UNIT)
        return {node: total[i] for i, node in enumerate(nodes) if total[i].any()}

    def _errors_ahead(self, table: DataFrame, base: np.ndarray, trees: list[Tree]) -> list[float]:
        """Mean error of the rows after each of the trees that follow on the cells' predictions so far."""
        width, n_features, metric, read = self.binner.width, len(self.binner.features), self.settings["metric"], self._bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grid = _grid(width, n_features)
            steps = [t.predict(grid) for t in trees]
            errors = np.zeros(len(trees) + 1)
            for batch in batches:
                at, y = _cells(read(batch.column(0)), width), batch.column(1).to_numpy()
                p = base[at]
                errors[-1] += len(y) * ERROR_UNIT
                for i, step in enumerate(steps):
                    p += step[at]
                    errors[i] += np.rint(_errors(y, p, metric) * ERROR_UNIT).sum()
            yield packed(0, errors.astype(np.int64))

        total = np.frombuffer(bytes(added(table.mapInArrow(run, "key int, values binary"), "<i8", 1).collect()[0]["values"]), np.int64)  # a number for each tree
        return [float(e / total[-1]) for e in total[:-1]]

    def _binned(self, whole: DataFrame, y: Column) -> DataFrame:
        binner, start = self.binner, self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binner.bins(batch.columns[2:])
                packed = pa.array([r.tobytes() for r in bins], pa.binary())
                yield pa.RecordBatch.from_arrays([packed, batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, start))], names=["bins", "y", "held", "p"])

        made = whole.select(y.alias("y"), "_held", *binner.inputs()).mapInArrow(run, "bins binary, y double, held boolean, p double")
        return _written(made, "binned")

    def _columns(self, batch: pa.RecordBatch, stored: int) -> tuple[np.ndarray, ...]:
        bins = self._bins(batch.column(0))
        p = batch.column(3).to_numpy().copy()
        for tree in self.trees[stored:]:
            p += tree.predict(bins)
        return bins, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), p

    @property
    def _bins(self) -> Callable[[pa.Array], np.ndarray]:
        kind, n_features = np.uint8 if self.binner.width <= 256 else np.uint16, len(self.binner.features)
        return lambda packed: np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), n_features)

    def _slopes(self, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature as whole steps of UNIT; gradients are scaled by their bound."""
        r = p - y
        if self.settings["objective"] == "huber":
            t = 1 + (r / self.delta) ** 2
            g, h = r / np.sqrt(t), t**-1.5
        else:
            g, h = r, np.ones_like(r)
        return np.rint(np.clip(g / self.bound, -1, 1) * UNIT), np.rint(h * UNIT)

    def _grow(self, first: dict[int, np.ndarray], histograms: Callable[[Tree, list[int]], dict[int, np.ndarray]]) -> Tree:
        s, tree = self.settings, Tree()
        bounds = {0: (-math.inf, math.inf)}
        for level in range(s["depth"]):
            if not bounds:
                break
            sums = first if level == 0 else histograms(tree, sorted(bounds))
            after: dict[int, tuple[float, float]] = {}
            for node, hist in sums.items():
                if level == 0:
                    tree.value[0] = self._value(hist[0].sum(axis=0), *bounds[0]) * s["rate"]
                found = self._best(hist, *bounds[node])
                if found is None:
                    continue
                gain, feature, cut, (left, right), (low, high) = found
                self.gains[feature] += gain
                self.uses[feature] += 1
                a, b = tree.split(node, feature, cut, (left * s["rate"], right * s["rate"]))
                after[a], after[b] = low, high
            bounds = after
        return tree

    def _value(self, total: np.ndarray, low: float, high: float) -> float:
        g, h = total[0] / UNIT * self.bound, total[1] / UNIT
        return float(np.clip(-g / (h + self.settings["l2"]), low, high))

    def _best(self, hist: np.ndarray, low: float, high: float):
        """The split of the greatest gain of one node: hist is (features, bins, [gradient, curvature, rows])."""
        s = self.settings
        left = hist.cumsum(axis=1)[:, :-1].astype(float)
        whole = hist.sum(axis=1, keepdims=True).astype(float)
        right = whole - left

        def worth(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            g, h = side[..., 0] / UNIT * self.bound, side[..., 1] / UNIT + s["l2"]
            v = np.clip(-g / h, low, high)
            return v, -(g * v + 0.5 * h * v * v)

        (vl, wl), (vr, wr), (_, w) = worth(left), worth(right), worth(whole)
        sign = np.array(s["signs"])[:, None]
        fine = (left[..., 2] >= s["least"]) & (right[..., 2] >= s["least"]) & (sign * (vr - vl) >= 0)
        gain = np.where(fine, wl + wr - w, -math.inf)
        feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        top = float(gain[feature, cut])
        if not top > 1e-12 * max(1.0, abs(float(w.max()))):
            return None
        a, b = float(vl[feature, cut]), float(vr[feature, cut])
        middle, way = (a + b) / 2, s["signs"][feature]
        sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[way]
        return top, int(feature), int(cut), (a, b), sides

    def _histograms(self, table: DataFrame, stored: int, tree: Tree, nodes: list[int]) -> tuple[dict[int, np.ndarray], float]:
        """((features, bins, [gradient, curvature, rows]) of fitted rows in each of the nodes, mean error of all trees that are done)."""
        n_features, width, metric = len(self.binner.features), self.binner.width, self.settings["metric"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(nodes), n_features, width, 3), dtype=np.int64)
            errors = np.zeros(4)
            lookup = np.full(len(tree.feature), -1)
            lookup[nodes] = range(len(nodes))
            for batch in batches:
                bins, y, held, p = self._columns(batch, stored)
                own = lookup[tree.nodes(bins)]
                rows = np.flatnonzero((own >= 0) & ~held)
                g, h = self._slopes(y[rows], p[rows])
                for f in range(n_features):
                    at = own[rows] * width + bins[rows, f]
                    for k, w in enumerate((g, h, None)):
                        total[:, f, :, k] += np.bincount(at, w, len(nodes) * width).astype(np.int64).reshape(len(nodes), width)
                e = np.rint(_errors(y, p, metric) * ERROR_UNIT)
                errors += held.sum() * ERROR_UNIT, e[held].sum(), (~held).sum() * ERROR_UNIT, e[~held].sum()
            yield packed(-1, errors.astype(np.int64))
            for i, node in enumerate(nodes):
                if total[i, 0].any():
                    yield packed(node, total[i])

        made = added(table.mapInArrow(run, "key int, values binary"), "<i8", len(nodes)).collect()  # a histogram for each node
        found = {r["key"]: np.frombuffer(bytes(r["values"]), np.int64) for r in made}
        n1, e1, n2, e2 = found.pop(-1)
        return {node: x.reshape(n_features, width, 3) for node, x in sorted(found.items())}, float(e1 / n1 if n1 else e2 / n2)

    def _advanced(self, table: DataFrame, stored: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = self._columns(batch, stored)[3]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["bins", "y", "held", "p"])

        return _written(table.mapInArrow(run, table.schema), "binned")

    # use

    def column(self, floor: float | None = 0.0) -> Column:
        """Predictions from the feature columns, not under the floor."""
        binner, trees, start = self.binner, self.trees, self.start
        by_cell, width = None, binner.width
        if len(trees) > STORED and self._has_cells():  # the trees are walked once for each cell, not for each row
            grid = _grid(width, len(binner.features))
            by_cell, trees = np.full(len(grid), start), []
            for tree in self.trees:
                by_cell += tree.predict(grid)

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            arrays = [pa.Array.from_pandas(c, type=pa.string() if name in binner.categories else pa.float64()) for name, c in zip(binner.features, columns, strict=True)]
            bins = binner.bins(arrays)
            p = np.full(len(bins), start) if by_cell is None else by_cell[_cells(bins, width)]
            for tree in trees:
                p += tree.predict(bins)
            return pd.Series(p if floor is None else np.maximum(p, floor))

        return run(*binner.inputs())

    def transform(self, df: DataFrame, out: str = "prediction", floor: float | None = 0.0) -> DataFrame:
        return df.withColumn(out, self.column(floor))

    def importance(self) -> list[tuple[str, float, int]]:
        """(feature, summed gain, splits), the greatest gain first, ties by name."""
        return sorted(zip(self.settings["features"], self.gains, self.uses, strict=True), key=lambda x: (-x[1], x[0]))

    # keeping

    def as_json(self) -> str:
        b = self.binner
        return json.dumps({"settings": self.settings, "start": self.start, "delta": self.delta, "bound": self.bound, "gains": self.gains, "uses": self.uses, "history": self.history, "cuts": b.cuts, "categories": b.categories, "trees": [t.as_dict() for t in self.trees]})

    @staticmethod
    def of_json(text: str) -> "HistogramBooster":
        d = json.loads(text)
        made = HistogramBooster(d["settings"]["features"])
        made.settings = d["settings"]
        for k in ("start", "delta", "bound", "gains", "uses", "history"):
            setattr(made, k, d[k])
        made.binner = Binner(d["settings"]["features"], d["cuts"], d["categories"])
        made.trees = [Tree.of(t) for t in d["trees"]]
        return made

    def save(self, spark: SparkSession, folder: str, keep: int = 3) -> None:
        self._snapshot(spark, folder, keep)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "HistogramBooster":
        """The model that the manifest names; where that one can't be read, the next older."""
        listed = json.loads(store.read_bytes(spark, f"{folder}/manifest.json"))["models"]
        for name in listed:
            try:
                return HistogramBooster.of_json(store.read_bytes(spark, f"{folder}/{name}").decode())
            except Exception as e:  # noqa: BLE001  py4j's errors for a missing file, json's for a broken one
                lost = e
        raise ValueError(f"no model in {folder} can be read") from lost

    def _snapshot(self, spark: SparkSession, folder: str, keep: int) -> None:
        """The model's file, then the manifest in one step, then what the manifest no longer names goes."""
        name = f"round-{len(self.trees):06d}.json"
        before = json.loads(store.read_bytes(spark, f"{folder}/manifest.json"))["models"] if store.exists(spark, f"{folder}/manifest.json") else []
        store.put_bytes(spark, f"{folder}/{name}", self.as_json().encode())
        listed = [name, *[x for x in before if x != name]][:keep]
        store.put_bytes(spark, f"{folder}/manifest.json", json.dumps({"models": listed}).encode())
        for x in store.names(spark, folder):
            if x.startswith("round-") and x not in listed:
                store.delete(spark, f"{folder}/{x}")

    def _resume(self, spark: SparkSession, folder: str) -> None:
        if not store.exists(spark, f"{folder}/manifest.json"):
            return
        found = HistogramBooster.load(spark, folder)
        same = all(found.settings[k] == v for k, v in self.settings.items() if k not in ("rounds", "patience"))
        if not same or found.start != self.start or found.binner.__dict__ != self.binner.__dict__:
            raise ValueError(f"{folder} holds a model of other settings or data")
        self.trees, self.history, self.gains, self.uses = found.trees, found.history, found.gains, found.uses


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch.path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stopping(history: DataFrame, patience: int, round_: str = "round", error: str = "error") -> DataFrame:
    """best_round, stopped: the round of the least error seen until the fit stops, and the round at which it stops: the first that is `patience`
    rounds after the best so far, or the last one. history has one row a round, from 1."""
    from pyspark.sql import Window as W

    so_far = W.orderBy(round_).rowsBetween(W.unboundedPreceding, 0)  # rounds of one fit are few
    seen = history.select(round_, F.min(F.struct(F.col(error).alias("e"), F.col(round_).alias("r"))).over(so_far)["r"].alias("best"))
    end = F.coalesce(F.min(F.when(F.col(round_) - F.col("best") >= patience, F.col(round_))), F.max(round_))
    stop = seen.agg(end.alias("stopped"))
    return seen.join(F.broadcast(stop), F.col(round_) == F.col("stopped")).select(F.col("best").alias("best_round"), "stopped")  # one row
