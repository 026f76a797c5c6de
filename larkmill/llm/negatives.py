"""Hard negatives: a vantage-point tree over norm-augmented vectors turns windows of scores into annuli of distance.

A vector x gets one more component, sqrt(M^2 - |x|^2), where M is the greatest norm; an anchor q is stretched to the norm M and gets 0
there. All then lie on one sphere, and distance(q, x)^2 = 2 M^2 - 2 score M / |q|: a higher score is a smaller distance. Rows
are dealt into blocks by a small tree over a bounded sample; each block has a tree of its own, which an anchor walks nearest first, inside
the annulus, until it has the rows it wants and nothing nearer is left. Scores are exact integers; distances only steer."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

#: Rows the top tree is fitted on, at most; every row is dealt by it, and the results don't depend on it.
SAMPLE = 16_384
#: Rows of a leaf of a block's tree, and anchors that walk a block's tree in one batch.
LEAF, WALKERS = 512, 512
#: Squared norms up to here keep every sum exact in a double; rows beyond take no part.
MOST_NORM = 2**52
ROW = "key binary, label long, vec binary, ids array<long>"
ASK = "key binary, label long, vec binary, windows array<struct<tag:long,lo:long,hi:long,floor:long>>"


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            keep, packed, keys = [], [], []
            for at, (label, own) in enumerate(zip(labels.to_pylist(), vectors, strict=True)):
                if own.values is None or own.values.null_count:
                    continue
                x = np.asarray(own.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                with np.errstate(all="ignore"):
                    x = np.floor(scale * x)
                    if not np.isfinite(x).all() or not x @ x <= MOST_NORM:
                        continue
                vec = np.trim_zeros(x.astype("<i4"), "b").tobytes()  # vectors that differ in zeros at their end only are equal
                keep.append(at)
                packed.append(vec)
                keys.append(hashlib.blake2b(vec + label.to_bytes(8, "little", signed=True), digest_size=16).digest())
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), labels.take(take), pa.array(packed, pa.binary()), pa.array(keys, pa.binary())], names=["id", "label", "vec", "key"])

    return run


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """id, label, vec, key of rows (id, label, vector) with a label, an id and finite components: vec holds floor(scale * x) as int32, without zeros at its
    end (missing components count as 0); key is a digest of label and vec."""
    whole = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return map_batches(whole.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>")), _quantised(scale), "id long, label long, vec binary, key binary")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """key, label, vec, ids: equal vectors of one label once, with their k least ids.

    Ties go to lesser ids, so no anchor that wants k - 1 rows beside itself can want a further copy. The rank is limited before the shuffle, so a vector that a
    third of all rows hold sends k rows from each task."""
    once = rows.select("key", "label", "vec", "id").distinct()
    ranked = once.selectExpr("*", "row_number() OVER (PARTITION BY key ORDER BY id) AS r").where(F.col("r") <= k)
    return ranked.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for row, own in zip(out, vectors, strict=True):
        x = np.frombuffer(own, "<i4")
        row[: len(x)] = x
    return out


class Space:
    """Augmented geometry: dims components and the greatest squared norm."""

    def __init__(self, dims: int, most: int):
        self.dims, self.most = dims, most
        self.slack = 1e-6 * math.sqrt(max(most, 1)) + 1e-6

    def points(self, vectors: list[bytes]) -> np.ndarray:
        x = _matrix(vectors, self.dims)
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None]])

    def askers(self, vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors as they are, stretched and augmented, by what they were stretched); a zero vector stays zero."""
        x = _matrix(vectors, self.dims)
        norm = np.sqrt((x * x).sum(axis=1))
        by = np.where(norm > 0, math.sqrt(self.most) / np.where(norm > 0, norm, 1), 0)
        return x, np.hstack([x * by[:, None], np.zeros((len(x), 1))]), by

    def radius(self, score: float, by: float) -> float:
        """Distance of rows with this score to an asker."""
        return math.sqrt(max((2.0 if by else 1.0) * self.most - 2.0 * score * by, 0.0))

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))


def _spread(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(d, kind="stable")
    half = len(order) // 2
    return order[:half], order[half:]


class Tree:
    """A vantage-point tree over points: vantage is the point farthest from the middle; halves by rank of the distance to it, so equal
    points are split too. Each child has the least and greatest distance of its points to the vantage."""

    def __init__(self, space: Space, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (vantage, (lo, hi, child), (lo, hi, child)) or (start, end)
        self.vantages: list[np.ndarray] = []
        self._grow(space, points, 0, len(points), leaf)
        self.seen = np.array(self.vantages) if self.vantages else np.zeros((0, space.dims + 1))

    def _grow(self, space: Space, points: np.ndarray, start: int, end: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((start, end))
        if end - start <= leaf:
            return at
        own = self.order[start:end]
        here = points[own]
        vantage = here[np.argmax(space.distances(here.mean(axis=0)[None], here)[0])]
        d = space.distances(vantage[None], here)[0]
        near, far = _spread(d)
        self.order[start:end] = np.concatenate([own[near], own[far]])
        number, middle = len(self.vantages), start + len(near)
        self.vantages.append(vantage)
        left = (d[near].min(), d[near].max(), self._grow(space, points, start, middle, leaf))
        right = (d[far].min(), d[far].max(), self._grow(space, points, middle, end, leaf))
        self.nodes[at] = (number, left, right)
        return at


class Block:
    """A tree with its rows in leaf order."""

    def __init__(self, space: Space, labels: list[int], vectors: list[bytes], ids: list[list[int]]):
        self.space = space
        points = space.points(vectors)
        self.tree = Tree(space, points, LEAF)
        order = self.tree.order
        self.rows = points[order, :-1].copy()
        self.labels = np.array(labels, dtype=np.int64)[order]
        self.ids = [ids[i] for i in order]

    def nearest(self, x: np.ndarray, by: float, to: np.ndarray, label: int, same: bool, lo: int, hi: int, floor: int, k: int, seen: dict[int, tuple] | None = None) -> list[tuple[int, int]]:
        """Up to k (score, id) of rows of the same label, or of others, with lo <= score <= hi and score >= floor, best first.

        x, by: the asker, and by what it was stretched; to: its distances to the vantages. Parts are taken nearest first; those wholly inside the annulus' hole, or beyond its
        rim, are left; the rim follows the k-th find. Ties are all looked at, so the lesser id wins. seen keeps the scores of the leaves for
        further windows of one asker."""
        seen = {} if seen is None else seen
        radius, slack = self.space.radius, self.space.slack
        outer, inner = radius(max(lo, floor), by) + slack, radius(hi, by) - slack
        found: list[tuple[int, int]] = []  # (-score, id)
        heap = [(0.0, 0)]
        nodes = self.tree.nodes
        while heap:
            near, at = heapq.heappop(heap)
            if near > outer:
                break
            node = nodes[at]
            if len(node) == 3:
                d = to[node[0]]
                for low, high, child in node[1:]:
                    least = max(near, d - high, low - d)
                    if least <= outer and d + high >= inner:
                        heapq.heappush(heap, (least, child))
                continue
            start, end = node
            if at not in seen:
                own = self.labels[start:end]
                rows = np.flatnonzero(own == label if same else own != label)
                less = -(self.rows[start:end] @ x)[rows]
                order = np.argsort(less)
                seen[at] = rows[order] + start, less[order]
            rows, less = seen[at]
            first, last = less.searchsorted(-hi), less.searchsorted(-max(lo, floor), "right")
            if last - first > k:  # only the k best of a leaf, and their ties, can be wanted
                last = less.searchsorted(less[first + k - 1], "right")
            if first >= last:
                continue
            found += [(int(less[i]), one) for i in range(first, last) for one in self.ids[rows[i]]]
            found = sorted(found)[:k]
            if len(found) == k:
                outer = min(outer, radius(-found[-1][0], by) + slack)
        return [(-s, one) for s, one in found]


class Dealer:
    """The top tree: rows to blocks, and blocks' bounds for askers. It holds a vantage for each block at most."""

    def __init__(self, space: Space, sample: list[bytes], n_blocks: int):
        self.space = space
        self.tree = Tree(space, space.points(sample), max(1, math.ceil(len(sample) / n_blocks)))
        self.paths: dict[int, list[int]] = {}
        self.mid: dict[int, float] = {}
        self._walk(0, [])
        self.leaves = {at: i for i, at in enumerate(self.paths)}

    def _walk(self, at: int, path: list[int]) -> None:
        node = self.tree.nodes[at]
        if len(node) == 2:
            self.paths[at] = path
            return
        self.mid[at] = node[2][0]  # what is nearer than the far half goes left
        self._walk(node[1][2], [*path, node[0]])
        self._walk(node[2][2], [*path, node[0]])

    def deal(self, vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(leaf number, distances to all vantages) of rows."""
        points = self.space.points(vectors)
        d = self.space.distances(points, self.tree.seen)
        out = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            at, own = todo.pop()
            node = self.tree.nodes[at]
            if len(node) == 2:
                out[own] = self.leaves[at]
                continue
            left = d[own, node[0]] < self.mid[at]
            todo += [(node[1][2], own[left]), (node[2][2], own[~left])]
        return out, d


class Index:
    """Rows of all classes in blocks, in the shared folder, with the bounds of each block."""

    def __init__(self, made: DataFrame, block_rows: int | None = None):
        """made: a written table of ROW. block_rows: about how many rows a block has; by default 32 times the root of their number, 4,096 at
        least, so that a block fits a task's memory and askers times blocks stay few."""
        size = F.octet_length("vec") / 4
        got = made.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("dims")).first()
        self.n, self.dims = got["n"], int(got["dims"] or 0)
        self.blocks = 0
        if not self.n:
            return
        norm = map_batches(made.select("vec"), _norms, "norm long").agg(F.max("norm")).first()[0]
        self.space = Space(self.dims, norm)
        block_rows = block_rows or max(4096, int(32 * math.sqrt(self.n)))
        sample = [bytes(r[0]) for r in made.select("vec", "key").orderBy("key").limit(SAMPLE).select("vec").collect()]
        self.dealer = dealer = Dealer(self.space, sample, math.ceil(self.n / block_rows))
        dealt = map_batches(made, lambda batches: _deal(dealer, batches), f"leaf long, reach array<double>, {ROW}")
        dealt = written(dealt, "dealt")
        # a leaf with more rows than the sample told is split by key, so that no block outgrows a task
        sizes = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        starts, at = {}, 0
        for leaf in sorted(sizes):
            starts[leaf] = at, math.ceil(sizes[leaf] / (2 * block_rows))
            at += starts[leaf][1]
        self.blocks = at
        first = F.create_map(*[x for leaf, (s, _) in starts.items() for x in (F.lit(leaf).cast("long"), F.lit(s))])
        parts = F.create_map(*[x for leaf, (_, n) in starts.items() for x in (F.lit(leaf).cast("long"), F.lit(n))])
        rows = dealt.withColumn("block", (first[F.col("leaf")] + F.pmod(F.xxhash64("key"), parts[F.col("leaf")])).cast("int"))
        self.rows = rows.select("block", "reach", *[c.split()[0] for c in ROW.split(", ")])
        reach = self.rows.select("block", F.posexplode("reach").alias("v", "d")).groupBy("block", "v").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
        n = len(self.dealer.tree.vantages)
        self.low, self.high = np.zeros((self.blocks, n)), np.full((self.blocks, n), np.inf)
        for r in reach:
            self.low[r["block"], r["v"]], self.high[r["block"], r["v"]] = r["lo"], r["hi"]

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """key, tag, score, id: the best k rows of each window of each ask (ASK), exactly.

        First each window is looked up in the one block that may be nearest; what it finds there is the floor for all others, of
        which those that can't reach it are left out. A block's rows and its askers meet in one task: rows first, askers after
        them in batches."""
        spark = asks.sparkSession
        if not self.blocks:
            return spark.createDataFrame([], "key binary, tag long, score long, id long")
        asks = written(asks, "asks")
        first = written(self._asked(asks, k, same, True), "first-finds")
        best = first.groupBy("key", "tag").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floor = best.where(F.col("n") >= k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "least"))).alias("known"))
        floor = written(floor.withColumnRenamed("key", "fkey"), "floors")
        open_ = F.transform("windows", lambda w: w.withField("floor", F.coalesce(F.element_at("known", w["tag"]), w["floor"])))
        again = asks.join(floor, F.col("key") == F.col("fkey"), "left").select("key", "label", "vec", open_.alias("windows"))
        found = first.unionByName(self._asked(again, k, same, False))
        ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY key, tag ORDER BY score DESC, id) AS r")
        return written(ranked.where(F.col("r") <= k).drop("r"), "finds")

    def _asked(self, asks: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        space, dealer, low, high = self.space, self.dealer, self.low, self.high
        one = lambda batches: _aim(space, dealer, low, high, first, batches)
        aimed = map_batches(asks, one, f"block int, kind int, {ASK}")
        rows = self.rows.select("block", F.lit(0).alias("kind"), "key", "label", "vec", F.lit(None).cast("array<struct<tag:long,lo:long,hi:long,floor:long>>").alias("windows"), "ids")
        both = rows.unionByName(aimed.withColumn("ids", F.lit(None).cast("array<long>")))
        met = both.repartitionById(self.blocks, F.col("block")).sortWithinPartitions("kind")
        return map_batches(met, lambda batches: _meet(space, k, same, batches), "key binary, tag long, score long, id long")


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.frombuffer(v, "<i4").astype(np.int64) for v in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(v @ v) for v in x], pa.int64())], names=["norm"])


def _deal(dealer: Dealer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            leaf, d = dealer.deal(batch.column("vec").to_pylist())
            reach = pa.array(list(d), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), reach, *batch.columns], names=["leaf", "reach", *batch.schema.names])


def _aim(space: Space, dealer: Dealer, low: np.ndarray, high: np.ndarray, first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each asker with the windows that a block may answer: in the first round the nearest such block of each window, later all others."""
    names = ["block", "kind", "key", "label", "vec", "windows"]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("tag", "lo", "hi", "floor")]))
    for batch in batches:
        out: list[tuple] = []
        vectors = batch.column("vec").to_pylist()
        if not vectors:
            continue
        _, q, by = space.askers(vectors)
        d = space.distances(q, dealer.tree.seen)
        for i, row in enumerate(batch.to_pylist()):
            if low.shape[1]:
                least = np.maximum(np.maximum(d[i] - high, low - d[i]).max(axis=1), 0)
                most = (d[i] + high).min(axis=1)
            else:
                least, most = np.zeros(len(low)), np.full(len(low), np.inf)
            want: dict[int, list] = {}
            for w in row["windows"]:
                rim = lambda score, stretch=by[i]: space.radius(score, stretch)
                # the first block depends on the window alone, so that both rounds agree on it
                may = np.flatnonzero((least <= rim(w["lo"]) + space.slack) & (most >= rim(w["hi"]) - space.slack))
                if not len(may):
                    continue
                home = may[np.argmin(least[may])]
                goes = [home] if first else [b for b in may if b != home and least[b] <= rim(max(w["lo"], w["floor"])) + space.slack]
                for b in goes:
                    want.setdefault(int(b), []).append(w)
            out += [(b, 1, row["key"], row["label"], row["vec"], w) for b, w in want.items()]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays(_columns(out, kind), names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(_columns(out, kind), names=names)


def _columns(out: list[tuple], kind: pa.DataType) -> list[pa.Array]:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), kind)
    return [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]


def _meet(space: Space, k: int, same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, vectors, ids = [], [], []
    block = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        n = int((kinds == 0).sum())  # rows come before askers
        if n:
            rows = batch.slice(0, n)
            labels += rows.column("label").to_pylist()
            vectors += rows.column("vec").to_pylist()
            ids += rows.column("ids").to_pylist()
        asked = batch.slice(n)
        if not asked.num_rows or not labels:
            continue
        if block is None:
            block = Block(space, labels, vectors, ids)
            vectors, ids = [], []
        for at in range(0, asked.num_rows, WALKERS):
            some = asked.slice(at, WALKERS).to_pylist()
            x, q, by = space.askers([r["vec"] for r in some])
            to = space.distances(q, block.tree.seen)
            out = []
            for i, r in enumerate(some):
                seen: dict[int, tuple] = {}
                for w in r["windows"]:
                    out += [(r["key"], w["tag"], s, one) for s, one in block.nearest(x[i], by[i], to[i], r["label"], same, w["lo"], w["hi"], w["floor"], k, seen)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "tag", "score", "id"])


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label, vector (other columns are ignored). Components become floor(scale * x), scores are exact integer inner products. An
    anchor is a row whose id meets `anchor` (a condition on the column id). Its positives are its first rows of the same label and another
    id, by score, then id. For each of them, the first rows of other labels with low * positive <= 100 * negative <= high * positive, by the
    same order, are its hard negatives; where there are none, there is no row.

    Rows without an id or a label, with a null vector, or with any component that is null, not finite or so large that the squared norm
    passes 2^52 take no part. Vectors of different lengths count as ended by zeros. Exact repeats (id, label, vector) are one row; rows of one id
    with other contents are rows of their own, but never positives of their own id. Equal vectors of one label are searched for once, and only
    their least ids can be wanted, so copies don't add work. An empty table gives no rows."""
    most = 2**62
    own = written(quantised(rows, scale), "vectors")
    made = written(classes(own, positives + 1), "classes")
    anchors = written(own.where(anchor).select(F.col("id").alias("anchor_id"), F.col("key").alias("akey")).distinct(), "anchors")
    index = Index(made, block_rows)
    asked = made.join(anchors.select(F.col("akey").alias("key")).distinct(), "key", "left_semi")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(-most).alias("lo"), F.lit(most).alias("hi"), F.lit(-most).alias("floor")))
    near = index.search(asked.select("key", "label", "vec", whole.alias("windows")), positives + 1, True)
    # a class has positives + 1 finds at most, so these lists are short; anchors of one class share them
    listed = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("near"))
    listed = written(listed, "near")
    windows = listed.select("key", F.explode(F.array_distinct(F.transform("near", lambda x: x["less"]))).alias("s")).where("s <= 0")
    # exact bounds in integers: the least n with 100 n >= low * p, the greatest with 100 n <= high * p
    lo, hi = F.expr(f"({low} * -s + 99) div 100"), F.expr(f"({high} * -s) div 100")
    windows = windows.select("key", F.struct((-F.col("s")).alias("tag"), lo.alias("lo"), hi.alias("hi"), F.lit(-most).alias("floor")).alias("w")).where("w.lo <= w.hi")
    windows = windows.groupBy("key").agg(F.collect_list("w").alias("windows"))
    hard = index.search(made.join(windows, "key").select("key", "label", "vec", "windows"), negatives, False)
    hard = hard.groupBy("key", "tag").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("hard"))
    hard = hard.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "hard"))).alias("hard"))
    both = written(listed.join(hard, "key").select(F.col("key").alias("ckey"), "near", "hard"), "near-and-hard")
    out = anchors.join(both, F.col("akey") == F.col("ckey"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    out = out.select("anchor_id", F.explode(others).alias("p"), "hard")
    out = out.select("anchor_id", "p", F.posexplode(F.element_at("hard", -F.col("p.less"))).alias("at", "n"))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), (-F.col("p.less")).alias("positive_score"), (-F.col("n.less")).alias("negative_score"))
