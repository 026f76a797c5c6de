"""Best-fit packing by minimum bin slack.

Only lengths matter to a packing, and there are at most `capacity` different ones. So the search runs on a histogram: for each bin a
bitset subset-sum dynamic program over the lengths that are left finds the fullest combination that holds the longest one left; the
combination is taken as often as the counts allow. The plan's size depends on the capacity and not on the number of pieces; the
pieces are then dealt into its slots in parallel, by their rank within their length."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, written
from .tokens import encoder

#: Slacks that are tried, as parts of the capacity, besides none.
SLACKS = (512, 64)
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), bins)] for {length: pieces}; every piece of 1 to capacity tokens is placed.

    Filling every bin to the brim spends the short pieces early, and the last bins stay half empty. So the search is done for several
    allowed slacks, each bin taking the longest pieces that come so close to the fullest sum, and the plan of the fewest bins is kept;
    of those that tie, the one with the least slack."""
    plans = [_plan(counts, capacity, slack) for slack in sorted({0, *(capacity // k for k in SLACKS)})]
    return min(plans, key=lambda plan: sum(bins for _, bins in plan))


def _plan(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Each bin starts with the longest length left (else long pieces would be stranded), and the fullest sum of the rest is found by
    bitsets: bit s of reach[i] says that s is a sum of the first i choices. The sum is read back from the longest choice on, each taken
    if what is left can then still come within the slack of the fullest sum."""
    left = {n: c for n, c in counts.items() if c > 0 and 0 < n <= capacity}
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    lengths = sorted(left)
    while lengths:
        top = lengths[-1]
        room = capacity - top
        used = {top: 1}
        if room:
            fits = lengths[: bisect.bisect_right(lengths, room)]
            mask = (1 << (room + 1)) - 1
            reach, items = [1], []
            for n in fits:
                # copies in powers of two: every number of copies up to the most is a sum of these
                most, k = min(left[n] - (n == top), room // n), 1
                while most > 0:
                    k = min(k, most)
                    items.append((n, k))
                    reach.append((reach[-1] | reach[-1] << (n * k)) & mask)
                    most -= k
                    k *= 2
            high = reach[-1].bit_length() - 1
            low = max(0, high - slack)
            for i in range(len(items) - 1, -1, -1):
                n, k = items[i]
                if high >= n * k:
                    least = max(0, low - n * k)
                    if reach[i] >> least & (1 << high - n * k - least + 1) - 1:
                        used[n] = used.get(n, 0) + k
                        low, high = low - n * k, high - n * k
                        if high <= 0:
                            break
        bins = min(left[n] // t for n, t in used.items())
        out.append((tuple(sorted(used.items(), reverse=True)), bins))
        for n, t in used.items():
            left[n] -= t * bins
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
    return out


def slots(plan: list) -> dict[str, np.ndarray]:
    """The plan as runs of slots: pieces of `length` with ranks from `rank` on go to bins from `bin` on, `times` to a bin, at `offset`."""
    seen: dict[int, int] = {}
    rows, first = [], 0
    for combo, bins in plan:
        offset = 0
        for n, t in combo:
            rows.append((n, seen.get(n, 0), first, t, offset))
            seen[n] = seen.get(n, 0) + t * bins
            offset += n * t
        first += bins
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "times", "offset"), cols, strict=True))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most `capacity` ids, end id included, written to the shared folder with their rank within the
    (part, length) they were counted in. Ids are little-endian unsigned 32-bit integers. Null text: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode_all, int(end_id).to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            values, counts = encode(batch.column(1), end)
            first = 0
            for doc_id, count in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                for piece, at in enumerate(range(0, count, capacity)):
                    n = min(capacity, count - at)
                    own = values[first + at : first + at + n].tobytes()
                    for col, v in zip(cols, (doc_id, piece, at, n, own, int(seen[n])), strict=True):
                        col.append(v)
                    seen[n] += 1
                first += count
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            a = [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)]
            a.insert(5, pa.array(np.full(len(cols[0]), part, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(a, names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return written(map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, PIECES), "pieces")


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (length, part, rank and any other columns) with sequence_id and offset; gapless from 0 in each sequence.

    A rank within (part, length) becomes a rank within the length by adding what lower parts hold of it: counts, not rows, meet in
    one task, at most one for each part. No length, however common, gathers its pieces anywhere. The plan has at most a few rows for
    each length, whatever the input, and travels with the tasks."""
    from pyspark.sql import Window as W

    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan_bins(total, capacity))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("part").alias("_p"), F.col("length").alias("_n"), F.coalesce("before", F.lit(0)).alias("_before"))
    ranked = pieces.join(before, (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_n")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("_before")).drop("_p", "_n", "_before", "part")
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1) << 40
        key = table["length"] * big + table["rank"]
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = cols["length"].to_numpy(zero_copy_only=False), cols["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * big + rank, side="right") - 1
            deep = rank - table["rank"][at]
            bins = table["bin"][at] + deep // table["times"][at]
            offset = table["offset"][at] + deep % table["times"][at] * length
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_batches(ranked, place, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids and their place: doc_id, piece, start, length, ids, sequence_id, offset.

    Null and empty texts are packed as the end id alone; repeated rows are packed as often as they come; an empty table gives an
    empty table. Only documents longer than the capacity are cut. Other columns are not carried; join by doc_id."""
    return assign(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
