"""SimHash fingerprints and their near duplicates: tiled exact comparison by exclusive-or and bit counts.

Fingerprints that may lie within the radius meet in blocks that share a key. Rows of a block are sorted by their number of one bits
and cut into tiles; a pair of tiles whose bit numbers differ by more than the radius everywhere is skipped, every other pair is
compared bit by bit. A block gives out a spanning forest of its links, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, map_batches, text_of, written
from .graph import components

#: Rows of a block beyond which it is split into pairs of parts, and rows of a tile.
BLOCK, TILE = 2048, 512
_STEP = 1 << 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, blank-joined, repeats included; fewer words: the whole sequence; none: nothing."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - k + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(k, len(words)) - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 where more than half of the hashes have it; none: 0."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 well-mixed bits of each hash (a public 64-bit finaliser); salt 0 leaves them."""
    if not salt:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, k: int = 5, parts: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp array<long>: `parts` 64-bit words of the fingerprint of each whole text. Null or wordless texts: zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(ascii_words(text), k)
                out.append([_signed(majority_bits(mixed(h, s))) for s in range(parts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, "doc_id long, fp array<long>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pigeonhole_keys(radius: int, segments: int) -> Column:
    """Keys of a one-word fingerprint such that any two within the radius share one: radius bits touch at most radius of the
    segments, so segments - radius of them agree in full."""
    edges = [64 * i // segments for i in range(segments + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(segments)]
    keys = []
    for i, chosen in enumerate(combinations(masks, segments - radius)):
        keys.append(F.struct(F.lit(i).alias("i"), F.element_at("fp", 1).bitwiseAND(F.lit(_signed(sum(chosen)))).alias("v")))
    return F.array(*keys)


def near_matrix(fps: np.ndarray, radius: int) -> np.ndarray:
    """Which rows (rows x words, uint64) differ in `radius` bits at most. Rows are sorted by their number of one bits and cut into tiles;
    pairs of tiles whose numbers differ by more than the radius everywhere are skipped."""
    ones = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    sorted_fps, ones, n = fps[order], ones[order], len(fps)
    near = np.zeros((n, n), dtype=bool)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            if ones[b] - ones[min(a + TILE, n) - 1] > radius:
                break  # sorted: all later tiles differ by more
            x, y = sorted_fps[a : a + TILE], sorted_fps[b : b + TILE]
            apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
            for w in range(1, fps.shape[1]):
                apart += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
            near[np.ix_(order[a : a + TILE], order[b : b + TILE])] = apart <= radius
            near[np.ix_(order[b : b + TILE], order[a : a + TILE])] = (apart <= radius).T
    return near


def _forest(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Star links (rep, least rep) of the groups that the rows of one block form. fps: rows x words, uint64."""
    near, n = near_matrix(fps, radius), len(reps)
    if np.count_nonzero(near) <= n:
        return []
    free, out = np.ones(n, dtype=bool), []
    for s in range(n):
        if not free[s]:
            continue
        free[s] = False
        group, front = [s], [s]
        while front:
            new = np.flatnonzero(near[front].any(axis=0) & free)
            free[new] = False
            front = new.tolist()
            group += front
        if len(group) > 1:
            own = reps[group]
            low = own.min()
            out += [(int(r), int(low)) for r in own if r != low]
    return out


def links(distinct: DataFrame, keys: Column, radius: int, parts: int) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius which share a key. distinct: rep long, fp array<long>.

    A key with more than BLOCK rows is split: its rows are dealt into parts, and each pair of parts becomes a block of its own."""
    keyed = distinct.select("rep", "fp", F.explode(keys).alias("key")).select("rep", "fp", F.col("key.i").alias("i"), F.col("key.v").alias("v"))
    hot = keyed.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    hot = hot.select("i", "v", F.ceil(F.col("n") / BLOCK).cast("int").alias("s"))
    met = keyed.join(hot, ["i", "v"])  # keys of one row are gone
    own = F.pmod(F.xxhash64("rep"), F.col("s")).cast("int")
    pair = F.when(F.col("s") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda t: F.least(own, t).cast("long") * F.col("s") + F.greatest(own, t)))
    met = met.select("rep", "fp", "i", "v", F.explode(pair).alias("u"))
    met = met.repartition(max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "i", "v", "u").sortWithinPartitions("i", "v", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = _columns(batch, parts)
            if rest is not None:
                now = tuple(np.concatenate((x, y)) for x, y in zip(rest, now, strict=True))
            cuts = _cuts(now[0])
            last = cuts[-1] if len(cuts) else 0
            yield _linked(now, np.concatenate(([0], cuts)), radius)
            rest = tuple(x[last:] for x in now)
        if rest is not None:
            yield _linked(rest, np.array([0, len(rest[0])]), radius)

    return map_batches(met.select("i", "v", "u", "rep", "fp"), run, "a long, b long")


def _columns(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
    fps = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, parts)
    return key, batch.column(3).to_numpy(zero_copy_only=False), fps


def _cuts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1


def _linked(rows: tuple, cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a == 2:
            if int(np.bitwise_count(rows[2][a] ^ rows[2][a + 1]).sum()) <= radius:
                x, y = int(rows[1][a]), int(rows[1][a + 1])
                out.append((max(x, y), min(x, y)))
        elif b - a > 2:
            out += _forest(rows[2][a:b], rows[1][a:b], radius)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], type=pa.int64()), pa.array([y for _, y in out], type=pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, segments: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp array<long>, component_id: the least doc_id reachable over 64-bit fingerprints within the radius, itself included.
    Candidates share segments - radius of the segments, so that nothing within the radius is missed.

    Null and wordless texts have zero fingerprints and link like any other; equal fingerprints are one node, so copies cost nothing;
    repeated rows come back as often as they came; a null id is never a component_id where its group has another. Empty: empty."""
    fps = written(fingerprints(docs, k, 1, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = links(distinct.where(F.col("rep").isNotNull()), pigeonhole_keys(radius, segments), radius, 1)
    roots = components(found)
    labelled = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(labelled, "fp").select("doc_id", "fp", "component_id")
