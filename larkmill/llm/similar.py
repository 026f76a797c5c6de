"""Groups of texts whose sets of distinct word shingles have a Jaccard similarity of 4/5 or more.

Candidates meet by a shingle that both have among their first ones in one random order of all shingles. Those of a shingle's list are
compared by SimHash: 256-bit fingerprints of the distinct shingles, tile by tile with exclusive-or and bit counts, tile pairs skipped
whose bit numbers differ beyond the radius. What lies within the radius is confirmed by the exact sizes of intersection and union.

First each text is confirmed against one leader of its list, then leaders among each other; then the rows that have one of another
group within the radius are compared with those of other groups, block by block, and links come out, never all pairs. Lists are cut
into blocks, however long they are."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, discard, map_batches, text_of, written
from .graph import components
from .simhash import majority_bits, mixed, near_matrix
from .sketches import shingle_hashes

#: Least similarity as a fraction; bits of the bitmap of asked sets; values in one output batch.
UP, DOWN, ASKED_BITS, VALUES = 4, 5, 22, 1 << 19
#: Words of a fingerprint, and the bits that may differ. Where sets of 10 shingles or more have a similarity of 4/5, each bit differs with
#: a probability of at most 0.161 (exact sums over all such sizes; 0.188 below 10), so 5 standard deviations more than the mean.
PARTS, RADIUS, RADIUS_SMALL, SMALL = 4, 71, 80, 10
#: Probability with which a pair of similarity 4/5 may share none of the first shingles; how many of them are counted to find hot ones.
MISS, COUNTED = 1e-12, 40
#: Rows of a block.
BLOCK = 1024


def row_key(text_col: str = "text") -> Column:
    """Tells rows of one id apart: a hash of the text."""
    return F.xxhash64(text_of(text_col))


def shingle_sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (the text's hash), d (a 64-bit digest of the set), n, fp array<long>, h array<long>: distinct shingle hashes, ascending
    as unsigned numbers; wordless texts have the one value 0."""
    names = ["doc_id", "th", "d", "n", "fp", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            for doc_id, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.unique(shingle_hashes(ascii_words(text), k))
                if not len(h):
                    h = np.zeros(1, dtype=np.uint64)
                d = int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)
                fp = np.array([majority_bits(mixed(h, s)) for s in range(PARTS)], dtype=np.uint64).view(np.int64)
                for column, x in zip(rows, (doc_id, th, d, len(h), fp, h.view(np.int64)), strict=True):
                    column.append(x)
                held += len(h)
                if held > VALUES:
                    yield _set_batch(rows)
                    rows, held = [[] for _ in names], 0
            yield _set_batch(rows)

    def _set_batch(rows: list[list]) -> pa.RecordBatch:
        fixed = [pa.array(x, type=pa.int64()) for x in rows[:4]]
        return pa.RecordBatch.from_arrays([*fixed, _lists(rows[4]), _lists(rows[5])], names=names)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("th"), text_of(text_col).alias("text"))
    return map_batches(given, run, "doc_id long, th long, d long, n long, fp array<long>, h array<long>")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin and end."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.int64((1 << bits) - 1)).astype(np.int64)  # the lower bits: the upper ones give the order


def hot_buckets(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Flags of shingle buckets (by a hash's lower bits) that far more texts have among their first shingles than others have. There
    are as many buckets as the first shingles ask for, at most 2^24: 2 MB of flags, whatever the corpus. Hot shingles go last in the
    common order, which steers cost and not the result."""
    total = sets.agg(F.sum(F.least("n", F.lit(COUNTED)))).first()[0] or 0
    bits = min(24, max(18, math.ceil(math.log2(total + 1)) - 6))
    step = 1 << 14
    least = int(8 * total / (1 << bits)) + 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            own += np.bincount(_bucket(_flat(batch.column(0))[0], bits), minlength=len(own))
        parts = [(a // step, own[a : a + step].astype(np.uint32)) for a in range(0, len(own), step)]
        parts = [(p, x.tobytes()) for p, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], type=pa.int32()), pa.array([x for _, x in parts], type=pa.binary())], names=["part", "n"])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(n, dtype=np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int32()), pa.array([np.packbits(s > least).tobytes() for s in sums.values()], type=pa.binary())], names=["part", "n"])

    counted = map_batches(sets.select(F.slice("h", 1, COUNTED).alias("h")), count, "part int, n binary").repartition(16, "part")
    flags = np.zeros(1 << bits, dtype=bool)
    for r in map_batches(counted, flag, "part int, n binary").collect():
        flags[r["part"] * step : (r["part"] + 1) * step] = np.unpackbits(np.frombuffer(r["n"], dtype=np.uint8)).astype(bool)
    return flags, bits


def first_shingles(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles by which a set meets others: the first ones in the common order, in which hot ones go last and chance decides.

    Of two sets with a similarity of 4/5, floor(n / 5) + 1 first ones of each always share one. But fewer do: at most n / 4 elements of the
    union aren't in both, so each of the first m elements is such a one with a probability of at most n / 4 over the n' that aren't hot,
    and all are with that to the power m. m is taken so that this is below MISS (20 where nothing is hot)."""
    n, cool = len(h), h[~hot]
    most = n - -(-UP * n // DOWN) + 1
    share = n / 4 / max(1, len(cool))
    m = min(most, math.ceil(math.log(MISS) / math.log(share))) if share < 0.9 else most
    return cool[:m] if m <= len(cool) else np.concatenate((cool, h[hot][: m - len(cool)]))


def postings(sets: DataFrame) -> DataFrame:
    """s, d: the first shingles of each set, equal sets once."""
    flags, bits = hot_buckets(sets)
    packed = np.packbits(flags).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            flat, at = _flat(batch.column(1))
            warm = hot[_bucket(flat, bits)]
            firsts = [first_shingles(flat[a:b], warm[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if firsts:
                yield _batch([np.concatenate(firsts), np.repeat(own, [len(f) for f in firsts])], ["s", "d"])

    return map_batches(sets.select("d", "h"), run, "s long, d long").distinct()


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in columns], names=names)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (s, u, own, d, n, root, fp) dealt and sorted by (s, u)."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("s", "u", "side", "d", "n", "root", "fp").repartition(n, "s", "u").sortWithinPartitions("s", "u", "d")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(number columns, fingerprints, cuts) of the batches, put together so that no block is split."""
    rest: tuple[list[np.ndarray], np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        fps = batch.column(6).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, PARTS)
        if rest is not None:
            cols, fps = [np.concatenate(x) for x in zip(rest[0], cols, strict=True)], np.concatenate((rest[1], fps))
        cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield [x[:last] for x in cols], fps[:last], np.concatenate(([0], cuts))
        rest = [x[last:] for x in cols], fps[last:]
    if rest is not None and len(rest[1]):
        yield rest[0], rest[1], np.array([0, len(rest[1])])


def _sized(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m can have the similarity."""
    return (m >= -(-UP * n // DOWN)) & (m <= DOWN * n // UP)


def _radius(n: np.ndarray) -> int:
    return RADIUS if n.min() >= SMALL else RADIUS_SMALL


def _near(n: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Rows x rows: within the radius, and of sizes that allow the similarity."""
    return near_matrix(fps, _radius(n)) & _sized(n[:, None], n[None])


def _pairs_of_two(cols: list[np.ndarray], fps: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all blocks that have two rows, at once."""
    at = cuts[:-1][np.diff(cuts) == 2]
    n, m = cols[4][at], cols[4][at + 1]
    apart = np.bitwise_count(fps[at] ^ fps[at + 1]).sum(axis=1, dtype=np.int64)
    good = _sized(n, m) & (apart <= np.where(np.minimum(n, m) >= SMALL, RADIUS, RADIUS_SMALL))
    return cols[3][at[good] + 1], cols[3][at[good]]


def _led(rows: DataFrame) -> DataFrame:
    """a, b: in each block every row that lies within the radius of an earlier leader, and that leader; others lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, fps, cuts in _whole(batches):
            a, b = _pairs_of_two(cols, fps, cuts)
            out = [[a], [b]]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo > 2:
                    d, near = cols[3][lo:hi], _near(cols[4][lo:hi], fps[lo:hi])
                    free = np.ones(hi - lo, dtype=bool)
                    for i in range(hi - lo):
                        if free[i]:
                            free[i] = False
                            got = np.flatnonzero(near[i] & free)
                            free[got] = False
                            out[0].append(d[got])
                            out[1].append(np.full(len(got), d[i]))
            yield _batch([np.concatenate(x) for x in out], ["a", "b"])

    return map_batches(_blocks(rows), run, "a long, b long").distinct()


def _touching(rows: DataFrame) -> DataFrame:
    """The rows that have one of another group within the radius in their block. Where a block has no more such pairs than twice the
    rows, the pairs come instead, as d and other: they meet in several lists, but count once. Either way no more than two rows come for
    each row of a block."""
    names = ["s", "u", "side", "d", "n", "root", "fp", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, fps, cuts in _whole(batches):
            chosen, first, second = np.zeros(len(fps), dtype=bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                root = cols[5][lo:hi]
                if (root != root[0]).any():
                    near = _near(cols[4][lo:hi], fps[lo:hi]) & (root[:, None] != root[None])
                    own, pairs = near.any(axis=1), np.count_nonzero(near) // 2
                    if pairs > 2 * np.count_nonzero(own):
                        chosen[lo:hi] = own
                    elif pairs:
                        i, j = np.nonzero(np.triu(near, 1))
                        first.append(cols[3][lo + i])
                        second.append(cols[3][lo + j])
            a, b = np.concatenate(first), np.concatenate(second)
            fixed = [pa.array(x[chosen]) for x in cols]
            yield pa.RecordBatch.from_arrays([*fixed, _lists(list(fps[chosen].view(np.int64))), pa.nulls(len(fixed[0]), pa.int64())], names=names)
            zero = pa.array(np.zeros(len(a), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(np.maximum(a, b)), zero, zero, pa.nulls(len(a), pa.list_(pa.int64())), pa.array(np.minimum(a, b))], names=names)

    return map_batches(_blocks(rows), run, "s long, u long, side long, d long, n long, root long, fp array<long>, other long")


def _linked(rows: DataFrame) -> DataFrame:
    """a, b: links between the groups of each block, exact: of the pairs within the radius, those whose sets are similar and
    whose groups earlier links haven't joined. rows: those of _touching with their sets, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, fps, cuts, sets in _whole_sets(batches):
            out: list[tuple[int, int]] = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                d, root = cols[3][lo:hi], cols[5][lo:hi]
                i, j = np.nonzero(np.triu(_near(cols[4][lo:hi], fps[lo:hi]), 1) & (root[:, None] != root[None]))
                if len(i):
                    alike = _alike(sets[lo:hi], i, j)
                    out += _joined(d, root, i[alike], j[alike])
            yield _batch([np.array([max(x) for x in out], dtype=np.int64), np.array([min(x) for x in out], dtype=np.int64)], ["a", "b"])

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("s", "u", "side", "d", "n", "root", "fp", "h").repartition(n, "s", "u").sortWithinPartitions("s", "u", "d")
    return map_batches(dealt, run, "a long, b long").distinct()


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """_whole with each row's set."""
    held: list[np.ndarray] = []

    def seen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _flat(batch.column(7))
            held.extend(flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield batch

    for cols, fps, cuts in _whole(seen()):
        n = len(fps)
        yield cols, fps, cuts, held[:n]
        del held[:n]


def _alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sets of rows i and j are similar. Shingles that two rows or more have become bits, so that a pair's intersection is
    a count of bits; where that would take too much memory, the sets are intersected as they are."""
    sizes = np.array([len(x) for x in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    words = int(place[-1]) // 64 + 1
    common = np.empty(len(i), dtype=np.int64)
    if len(sets) * words <= 1 << 21:
        row = np.repeat(np.arange(len(sets)), sizes)
        live = times[number] > 1
        row, at = row[live], place[number[live]]
        bits = np.zeros((len(sets), words * 64), dtype=bool) if len(sets) * words <= 1 << 16 else None
        if bits is not None:
            bits[row, at] = True
            packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        else:
            packed = np.zeros((len(sets), words), dtype=np.uint64)
            np.bitwise_or.at(packed, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        step = max(1, (1 << 19) // words)
        for k in range(0, len(i), step):
            common[k : k + step] = np.bitwise_count(packed[i[k : k + step]] & packed[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    else:
        for k in range(len(i)):
            common[k] = len(np.intersect1d(sets[i[k]], sets[j[k]], assume_unique=True))
    return DOWN * common >= UP * (sizes[i] + sizes[j] - common)


def _joined(d: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (i, j) those that join two groups which earlier ones haven't joined."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(int(root[a])), top(int(root[b]))
        if x != y:
            parent[x] = y
            out.append((int(d[a]), int(d[b])))
    return out


def _grouped(met: DataFrame, roots: DataFrame) -> DataFrame:
    return met.join(roots, F.col("d") == F.col("node"), "left").select("s", "d", "n", "fp", F.coalesce("root", "d").alias("root"))


def _part(count: Column) -> Column:
    """A row's part of a list of so many rows."""
    return F.pmod(F.xxhash64("d"), F.ceil(count / BLOCK).cast("int")).cast("long")


def _leaders(rows: DataFrame) -> DataFrame:
    """One row for each list and group, in lists of two groups or more; long lists in parts."""
    first = rows.groupBy("s", "root").agg(F.min(F.struct("d", "n", "fp")).alias("x")).select("s", "root", "x.*")
    size = first.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return first.join(size, "s").withColumns({"u": _part(F.col("c")), "side": F.lit(0).cast("long")})


def _sides(rows: DataFrame) -> DataFrame:
    """All rows of lists that hold two groups or more. A list of up to BLOCK rows is one block. The rows of a longer one's commonest
    group are dealt into parts, the others too, and each part meets the others' parts: blocks of about 2 * BLOCK rows, in which every
    pair of different groups meets. Rows of the commonest group are copied once for every BLOCK of the others."""
    size = rows.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.sum("c").alias("c"), F.max("c").alias("top"), F.max_by("root", "c").alias("main"), F.count(F.lit(1)).alias("groups"))
    met = rows.join(size.where("groups > 1"), "s").withColumn("side", (F.col("root") != F.col("main")).cast("long"))
    mine, rest = _part(F.col("top")), _part(F.col("c") - F.col("top"))
    across = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("c") - F.col("top")) / BLOCK) - 1)
    along = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("top") / BLOCK) - 1)
    wide = 1 << 30
    number = lambda i, j: i * wide + j + 1
    main = F.transform(across, lambda j: number(mine, j))
    own = F.transform(across, lambda j: -number(F.least(rest, j), F.greatest(rest, j)))
    u = F.when(F.col("c") <= BLOCK, F.array(F.lit(0).cast("long"))).when(F.col("side") == 0, main).otherwise(F.concat(F.transform(along, lambda i: number(i, rest)), own))
    return met.select("s", "d", "n", "fp", "root", "side", F.explode(u).alias("u"))


def _asked(wanted_sets: DataFrame, sets: DataFrame) -> DataFrame:
    """d, h of the sets whose d is asked for, once each; a bitmap of fixed size keeps most others from being moved."""
    slot = F.shiftrightunsigned("d", 64 - ASKED_BITS) + 1
    asked = wanted_sets.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
    size = 1 << 15
    flags = np.zeros(1 << ASKED_BITS, dtype=bool)
    for r in asked:  # 128 rows of 4 kB at most
        flags[(r["k"] - 1) * size : r["k"] * size] = np.unpackbits(np.frombuffer(bytes(r["m"]), dtype=np.uint8), bitorder="little").astype(bool)
    bits = np.packbits(flags).tobytes()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        for batch in batches:
            d = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(wanted[(d >> np.uint64(64 - ASKED_BITS)).astype(np.int64)]))

    some = map_batches(sets.select("d", "h"), keep, "d long, h array<long>")
    return written(some.groupBy("d").agg(F.any_value("h").alias("h")), "asked")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: those of the pairs whose sets are similar, by the sizes of their intersection and union."""
    pairs = written(pairs, "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, p), (y, q) = _flat(batch.column(2)), _flat(batch.column(3))
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(len(good)):
                u, v = x[p[i] : p[i + 1]], y[q[i] : q[i + 1]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                good[i] = DOWN * common >= UP * (len(u) + len(v) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    some = _asked(pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))), sets)
    both = pairs.join(some.select(F.col("d").alias("a"), F.col("h").alias("x")), "a").join(some.select(F.col("d").alias("b"), F.col("h").alias("y")), "b")
    links = written(map_batches(both.select("a", "b", "x", "y"), compare, "a long, b long"), "links")
    discard(pairs, some)
    return links


def grouped_rows(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (row_key), g: one row for each of docs; rows of one g are linked by pairs of texts whose distinct k-word shingles have
    a Jaccard similarity of 4/5 or more.

    Every such pair counts, but for one in 10^6 by its fingerprints and one in 10^12 by its first shingles, and no other (shingles and sets
    are told apart by 64-bit hashes). Texts of fewer than k words are one shingle; null and wordless texts equal each other; repeated rows come back as
    often as they came; a null id is a row like any other. Empty: empty."""
    sets = written(shingle_sets(docs, k, id_col, text_col), "sets")
    nodes = sets.groupBy("d").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"))
    shown = written(postings(sets), "postings")
    common = shown.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s")
    met = written(shown.join(common, "s").join(nodes, "d").select("s", "d", "n", "fp"), "met")
    discard(shown)
    found = _confirmed(_led(_leaders(met.withColumn("root", F.col("d")))), sets)
    found = found.union(_confirmed(_led(_leaders(_grouped(met, written(components(found), "roots")))), sets))
    touching = written(_touching(_sides(_grouped(met, written(components(found), "roots")))), "touching")
    discard(met)
    few = _confirmed(touching.where("other IS NOT NULL").select(F.col("d").alias("a"), F.col("other").alias("b")).distinct(), sets)
    dense = touching.where("other IS NULL").drop("other")
    asked = _asked(dense.select("d"), sets)
    found = found.union(few).union(written(_linked(dense.join(asked, "d")), "links"))
    discard(touching, asked)
    roots = components(found)
    out = written(sets.join(roots, F.col("d") == F.col("node"), "left").select("doc_id", "th", F.coalesce("root", "d").alias("g")), "groups")
    discard(sets)
    return out


def similar_groups(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the least doc_id of the row's group (grouped_rows). A null id is never a component_id where its group has
    another."""
    rows = grouped_rows(docs, k, id_col, text_col)
    return rows.join(rows.groupBy("g").agg(F.min("doc_id").alias("component_id")), "g").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that with the least id (nulls last), and of one id the text with the least hash. Rows are judged,
    not ids: where one id has several texts, each stays or goes with its own group; of equal rows under one id one stays.

    Null and wordless texts are copies of each other, so one stays; empty: empty. Other columns play no part and keep their values."""
    rows = grouped_rows(docs, k, id_col, text_col)
    key = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    kept = rows.groupBy("g").agg(F.min(key).alias("k"))
    # one row for each (doc_id, th) that goes or is there several times
    marked = rows.join(kept, "g").groupBy("doc_id", "th").agg(F.max((key != F.col("k")).cast("int")).alias("_lm_gone"), F.count(F.lit(1)).alias("n"))
    marked = written(marked.where("_lm_gone = 1 OR n > 1").select(F.col("doc_id").alias("_lm_id"), F.col("th").alias("_lm_of"), "_lm_gone"), "marked")
    own = docs.withColumn("_lm_th", row_key(text_col))
    at = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_lm_id")) & (F.col("_lm_th") == F.col("_lm_of"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    left = own.join(marked, at, "left_anti").select(*names)
    twice = marked.where("_lm_gone = 0")
    if twice.isEmpty():
        return left
    return left.unionByName(own.join(twice, at).dropDuplicates([id_col, "_lm_th"]).select(*names))
