"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m characters with at most e edits keeps m + 1 - q - e * q of the item's character q-grams, all within
e + 1 diagonals. So the distinct places of the item whose q-grams the text has are counted in overlapping bands of diagonals. Bands that
reach the bound, neighbours put together, are searched for the least number of edits by bit vectors, and what is within the budget is
verified by a banded alignment, which gives the place."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, written

#: Gram length, edits allowed for each character of an item, and characters of benchmark that one pass sends to the tasks.
Q, EDITS, PASS_CHARS = 10, 0.08, 2_000_000
_GROUP, _PAIRS = 1 << 19, 1 << 20
_B = 0x9E3779B97F4A7C15
_BITS = 22


def normalise(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join((text or "").replace("\0", " ").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q characters, by doubling."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h, w = c.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9), 1
        made, have = None, 0
        for bit in range(q.bit_length()):
            if q >> bit & 1:
                if made is None:
                    made, have = h, w
                else:
                    made = made[: len(made) - w] * np.uint64(pow(_B, w, 1 << 64)) + h[have:][: len(made) - w]
                    have += w
            if w * 2 <= q:
                h = h[:-w] * np.uint64(pow(_B, w, 1 << 64)) + h[w:]
            w *= 2
    return made[:n]


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Index:
    ids: list[int]
    texts: list[str]
    q: int
    edits: np.ndarray  # allowed for each item
    need: np.ndarray  # shared grams that the lemma asks for
    keys: np.ndarray  # distinct gram hashes, ascending
    first: np.ndarray  # where each key's (item, place) pairs begin
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    short: list[int]  # items with fewer than q characters: found as they stand


def build_index(items: list[tuple[int, str | None]], q: int = Q, rate: float = EDITS) -> Index:
    kept = [(i, t) for i, raw in items if (t := normalise(raw))]
    m = np.array([len(t) for _, t in kept], dtype=np.int64)
    edits = np.maximum(0, np.minimum((m * rate).astype(np.int64), (m - q) // q)) if len(kept) else m
    need = m + 1 - q - edits * q
    hs, it, pl = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, (_, t) in enumerate(kept):
        h = gram_hashes(codes(t), q)
        hs.append(h)
        it.append(np.full(len(h), k, dtype=np.int64))
        pl.append(np.arange(len(h), dtype=np.int64))
    h, it, pl = np.concatenate(hs), np.concatenate(it), np.concatenate(pl)
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << _BITS, dtype=bool)
    with np.errstate(over="ignore"):
        seen[_slot(keys)] = True
    return Index([i for i, _ in kept], [t for _, t in kept], q, edits, need, keys, np.append(first, len(h)), it[order].astype(np.int32), pl[order].astype(np.int32), seen, np.flatnonzero(m < q).tolist())


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, start) of the best occurrence of item in text whose path stays within diagonals low to high (text place less item
    place) widened by `most`; ends in the text are free. None beyond `most` edits."""
    low, high = low - most, high + most
    d = np.arange(low, high + 1)
    big = len(item) + most + 1
    cost = np.where((d >= 0) & (d <= len(text)), 0, big)  # row 0: start anywhere
    start = d.copy()
    step = np.arange(len(d))
    for i, c in enumerate(item):
        at = d + i  # text place that the diagonal step reads
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(d), dtype=bool)
        same[inside] = text[at[inside]] == c
        new = cost + ~same
        new[~inside] = big
        begun = start.copy()
        skip = np.append(cost[1:] + 1, big)  # item character without text: next higher diagonal of the row before
        better = skip < new
        new = np.where(better, skip, new)
        begun = np.where(better, np.append(start[1:], 0), begun)
        # text characters without item: along the row, one more for each diagonal
        flat = new - step
        run = np.minimum.accumulate(flat)
        src = np.maximum.accumulate(np.where(flat == run, step, 0))
        cost, start = np.minimum(run + step, big), begun[src]
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k])) if cost[k] <= most else None


def least_edits(item: str, text: str) -> tuple[int, int]:
    """(edits, end) of the best occurrence of item in text, by bit vectors as wide as the item; of ends that tie, the first."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    all_, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, score = all_, 0, len(item)
    best = (score, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        more, less = down | (all_ & ~(d0 | up)), up & d0
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score < best[0]:
                best = (score, end)
        more, less = more << 1, less << 1  # no one is carried in: an occurrence may start anywhere
        up, down = (less | (all_ & ~(d0 | more))) & all_, more & d0 & all_
    return best


def find(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each normalised text: (item id, edits, place, shared grams), the best place of each item found."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for k in index.short:
        for d, t in enumerate(texts):
            if (at := t.find(index.texts[k])) >= 0:
                out[d].append((index.ids[k], 0, at, 0))
    a = 0
    while a < len(texts):  # whole texts together, up to about _GROUP characters
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= _GROUP):
            size += len(texts[b]) + 1
            b += 1
        _find_group(index, texts, a, b, out)
        a = b
    return out


def _find_group(index: Index, texts: list[str], a: int, b: int, out: list) -> None:
    if not len(index.keys):
        return
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
    c = codes("\0".join(texts[a:b]))
    h = gram_hashes(c, index.q)
    with np.errstate(over="ignore"):
        at = np.flatnonzero(index.seen[_slot(h)])
    key = np.searchsorted(index.keys, h[at])
    ok = index.keys[np.minimum(key, len(index.keys) - 1)] == h[at]
    at, key = at[ok], key[ok]
    if not len(at):
        return
    many = index.first[key + 1] - index.first[key]
    doc = np.searchsorted(starts, at, side="right") - 1
    for lo, hi, items in _slices(many, doc, len(index.ids)):
        _find_pairs(index, texts, a, starts, c, at[lo:hi], key[lo:hi], doc[lo:hi], many[lo:hi], items, out)
    for own in out[a:b]:
        own.sort()


def _slices(many: np.ndarray, doc: np.ndarray, items: int) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Runs of places, each of whole texts, with about _PAIRS (place, item place) pairs; a text with more is taken in parts of the items."""
    edges = np.concatenate((np.flatnonzero(np.diff(doc, prepend=-1)), [len(doc)])).tolist()
    lo, total = 0, np.concatenate(([0], np.cumsum(many)))
    for k in range(1, len(edges)):
        if k + 1 == len(edges) or total[edges[k + 1]] - total[lo] > _PAIRS:
            size = int(total[edges[k]] - total[lo])
            parts = -(-size // _PAIRS) if size > _PAIRS else 1
            step = -(-items // parts)
            for p in range(0, items, step):
                yield lo, edges[k], (p, p + step) if parts > 1 else None
            lo = edges[k]


def _find_pairs(index: Index, texts: list[str], a: int, starts: np.ndarray, c: np.ndarray, at: np.ndarray, key: np.ndarray, doc: np.ndarray, many: np.ndarray, items: tuple[int, int] | None, out: list) -> None:
    found = []
    total = np.concatenate(([0], np.cumsum(many)))
    lo = 0
    while lo < len(at):  # at most about _PAIRS pairs at once
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, side="right")) - 1)
        m = many[lo:hi]
        pairs = np.repeat(index.first[key[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        item, place, row = index.item[pairs].astype(np.int64), index.place[pairs].astype(np.int64), np.repeat(np.arange(lo, hi), m)
        if items is not None:
            own = (item >= items[0]) & (item < items[1])
            item, place, row = item[own], place[own], row[own]
        found.append((doc[row] * len(index.ids) + item, (at[row] - place + (1 << 24)) // (index.edits[item] + 1), place))
        lo = hi
    which, band, place = (np.concatenate(x) for x in zip(*found, strict=True))
    which, where = np.concatenate((which, which)), np.concatenate((band, band - 1)) << 26 | np.concatenate((place, place))  # each band overlaps the next by half
    order = np.lexsort((where, which))
    which, where = which[order], where[order]
    fresh = np.concatenate(([True], (which[1:] != which[:-1]) | (where[1:] != where[:-1])))  # a place of the item counts once in a band
    which, band = which[fresh], where[fresh] >> 26
    begin = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (band[1:] != band[:-1]))))
    counts = np.diff(np.append(begin, len(which)))
    which, band = which[begin], band[begin]
    live = counts >= index.need[which % len(index.ids)]
    rows = list(zip(which[live].tolist(), band[live].tolist(), counts[live].tolist(), strict=True))
    k = 0
    while k < len(rows):
        own, first, n = rows[k]
        last = first
        while k < len(rows) and rows[k][0] == own and rows[k][1] <= last + 2:  # neighbouring bands
            last, n = rows[k][1], max(n, rows[k][2])
            k += 1
        d, i = divmod(own, len(index.ids))
        e, begun = int(index.edits[i]), int(starts[d])
        low, high = first * (e + 1) - (1 << 24) - begun, (last + 2) * (e + 1) - 1 - (1 << 24) - begun
        got = verified(index.texts[i], texts[a + d], low, high, e)
        if got:
            mine = out[a + d]
            old = next((x for x, r in enumerate(mine) if r[0] == index.ids[i]), None)
            row = (index.ids[i], *got, n)
            if old is None:
                mine.append(row)
            elif row[1] < mine[old][1]:
                mine[old] = row


def verified(item: str, text: str, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, place) of the best occurrence on the diagonals low to high, if it has at most so many edits."""
    lo, hi = max(0, low - most), min(len(text), high + most + len(item))
    part = text[lo:hi]
    if (exact := part.find(item)) >= 0:
        return 0, exact + lo
    edits, end = least_edits(item, part)
    if edits > most:
        return None
    got = banded_edits(codes(item), codes(part), end - len(item), end - len(item), most)
    return (got[0], got[1] + lo) if got else None


def _passes(benchmark: DataFrame, q: int, rate: float) -> Iterator[Index]:
    """The benchmark as indexes of at most PASS_CHARS characters each (or one item), one after the other: its size is checked here, and a
    larger one takes more passes over the documents instead of more memory."""
    rows = benchmark.select("item_id", text_of().alias("text")).orderBy("item_id", "text").toLocalIterator()
    own, size = [], 0
    for r in rows:
        if own and size + len(r["text"]) > PASS_CHARS:
            yield build_index(own, q, rate)
            own, size = [], 0
        own.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield build_index(own, q, rate)


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, at (character of the normalised text), shared_grams: each benchmark item found in each document.

    Texts and items are compared in lower case with white space as single blanks. Null and empty texts and items match nothing; items
    of fewer than q characters are found as they stand; repeated rows are reported as often as they come; empty tables give none. Where
    the benchmark takes several passes, each one's rows are written before the next index is made."""
    made: list[DataFrame] = []
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def one(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = find(index, [normalise(t) for t in batch.column(1).to_pylist()])
                rows = [(d, *r) for d, own in zip(batch.column(0).to_pylist(), got, strict=True) for r in own]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "edits", "at", "shared_grams"])

        return map_batches(given, run, "doc_id long, item_id long, edits int, at long, shared_grams int")

    passes = _passes(benchmark, q, rate)
    index = next(passes)
    for after in passes:
        made.append(written(one(index), "leaks"))
        index = after
    return functools.reduce(DataFrame.unionByName, [*made, one(index)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDITS, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay. Rows are judged where they lie: nothing is shuffled. Null and
    empty texts stay, repeated rows are treated alike; an empty table stays empty, an empty benchmark drops nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_col)

    def one(docs: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = find(index, [normalise(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not g for g in got], type=pa.bool_()))

        return map_batches(docs, run, schema)

    passes = _passes(benchmark, q, rate)
    index = next(passes)
    for after in passes:
        docs = written(one(docs, index), "clean")
        index = after
    return one(docs, index)
