"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes marks chunk ends by content, so an insertion moves only the chunks it touches. Ends lie where
words end, or before characters of scripts without blanks. Chunks are deduplicated by digest; those that more than one document holds
are anchors: neighbouring ones make a stretch, which grows word by word on both sides as far as the other document has the same words.

Texts are chunked twice: first only digests and ids are counted, then the rows of repeated chunks alone move."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, written

#: Least and greatest chunk size in bytes, the word ends on either side whose hashes must be greater where a chunk ends (about one word end
#: in seven is such a one, and gaps are seldom long), words compared on either side of a stretch, and
#: the least number of words of a reported stretch: a passage of 50 words reaches 45 though its first or last words may be beyond reach.
LEAST, MOST, BESIDE, REACH, MIN_WORDS = 1, 512, 3, 24, 45
#: Slots (log 2) of the bitmap of repeated digests.
SLOT_BITS = 26
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], dtype=np.uint32)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: First bytes of characters of scripts that are written without blanks (U+3000 to U+D7FF); about one in twelve begins a chunk.
_DENSE = (np.arange(256) >= 0xE3) & (np.arange(256) <= 0xED)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of gear[b] << age over the last 32 bytes, by doubling windows of 1, 2, 4, 8 and 16. Its lower
    16 bits know the last 16 bytes."""
    h = _GEAR[data]
    with np.errstate(over="ignore"):
        for w in (1, 2, 4, 8, 16):
            later = h[w:] + (h[:-w] << np.uint32(w)) if len(h) > w else h[:0]
            h = np.concatenate((h[:w], later))
    return h


def _ends(data: np.ndarray, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of bytes; the last is the length."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64)
    low = gear_hashes(data)[:-1] & np.uint32(0xFFFF)  # at place i - 1: before byte i
    blank, next_ = _BLANK[data[:-1]], data[1:]
    word_end = ~blank & _BLANK[next_]
    marks = _DENSE[next_] & (low < 65536 // 12)
    at = np.flatnonzero(word_end)
    own, least = low[at], np.ones(len(at), dtype=bool)
    for lag in range(1, BESIDE + 1):
        least[lag:] &= own[lag:] < own[:-lag]
        least[:-lag] &= own[:-lag] < own[lag:]
    for lag in (1, 2, 3, 4):  # a few words over and over have few hashes, perhaps none the least: there every word is an end
        least[lag:] |= own[lag:] == own[:-lag]
    marks[at[least]] = True
    ends = np.append(np.flatnonzero(marks) + 1, n)
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > most)
    if len(wide):  # cut from the last end on, so that the places depend on what lies behind it only
        step = most - LEAST
        more = [np.arange(e - g + step, e - LEAST, step) for e, g in zip(ends[wide].tolist(), gaps[wide].tolist(), strict=True)]
        ends = np.sort(np.concatenate((ends, *more)))
    return ends


def cut_points(data: bytes) -> list[int]:
    return _ends(np.frombuffer(data, dtype=np.uint8)).tolist()


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far has asked for."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(2 * n, b, dtype=np.uint64)), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return self.up, self.down


_powers = _Powers()


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end]: a polynomial in the bytes, mixed (public finaliser)."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64)))
        z = (sums[end] - sums[begin]) * up[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def chunks_of(text: str, around: bool = False) -> tuple[np.ndarray, ...]:
    """(at, size, digest, words that begin in the chunk) of a text's chunks; around: also the hashes of the REACH words before (nearest first)
    and after each, as rows of 8-bit numbers (a wrong match in 255 adds a word), 0 where there is no word."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    ends = _ends(data)
    at = np.concatenate((ends[:0], [0], ends[:-1])) if len(ends) else ends
    digest = _hashes(data, at, ends).view(np.int64)
    blank = np.concatenate(([True], _BLANK[data], [True])) if len(data) else np.ones(2, dtype=bool)
    begins, stops = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    first = np.searchsorted(begins, at)  # words that begin before the chunk
    last = np.searchsorted(begins, ends)
    if not around:
        return at, ends - at, digest, last - first
    words = np.concatenate((np.zeros(REACH, dtype=np.uint8), np.maximum(_hashes(data, begins, stops).astype(np.uint8), 1), np.zeros(REACH, dtype=np.uint8)))
    step = np.arange(REACH)
    # a word that the chunk's start cuts is whole on neither side: the one before it comes first
    return at, ends - at, digest, last - first, words[REACH + first[:, None] - 1 - step], words[REACH + last[:, None] + step]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: bytes | None = None) -> DataFrame:
    """doc_id, th (the text's hash), at, size (bytes of the UTF-8 text), digest, words, before, after (REACH 8-bit hashes each) of every chunk
    of every whole text, or of those whose digest's slot is set in a bitmap. Null and empty texts have none, rows without an id neither."""
    names = ["doc_id", "th", "at", "size", "digest", "words", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if slots is None else np.unpackbits(np.frombuffer(slots, dtype=np.uint8)).astype(bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids, ths, counts, rows = part.column(0).to_numpy(), part.column(1).to_numpy(), [], []
                for text in part.column(2).to_pylist():
                    own = chunks_of(text, True)
                    if wanted is not None:
                        chosen = wanted[_slots(own[2])]
                        own = tuple(x[chosen] for x in own)
                    counts.append(len(own[0]))
                    rows.append(own)
                at, size, digest, words, before, after = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.repeat(ths, counts)), pa.array(at.astype(np.int64)), pa.array(size.astype(np.int32)),
                    pa.array(digest), pa.array(words.astype(np.int32)), _binary(before), _binary(after)], names=names)

    return map_batches(_texts(docs, id_col, text_col), run, "doc_id long, th long, at long, size int, digest long, words int, before binary, after binary")


def _binary(rows: np.ndarray) -> pa.Array:
    ends = np.arange(0, REACH * len(rows) + 1, REACH, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _slots(digest: np.ndarray) -> np.ndarray:
    return (digest.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _repeated_slots(docs: DataFrame, within: bool, id_col: str, text_col: str) -> bytes:
    """A bitmap (8 MB, whatever the corpus) of the digests that more than one id holds, or on demand one id twice. It steers what
    moves: counts are taken again from the rows that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                own = [chunks_of(t)[2] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in own]))], names=["digest", "doc_id"])

    rows = map_batches(_texts(docs, id_col, text_col).select("doc_id", "text"), run, "digest long, doc_id long")
    seen = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *([F.count(F.lit(1)).alias("n")] if within else []))
    slot = F.shiftrightunsigned("digest", 64 - SLOT_BITS) + 1
    maps = seen.where("first < last" + (" OR n > 1" if within else "")).groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m"))
    size, flags = 1 << 15, np.zeros(1 << SLOT_BITS, dtype=bool)
    for r in maps.toLocalIterator():
        flags[(r["k"] - 1) * size : r["k"] * size] = np.unpackbits(np.frombuffer(bytes(r["m"]), dtype=np.uint8), bitorder="little").astype(bool)
    return np.packbits(flags).tobytes()


def repeats(docs: DataFrame, min_bytes: int | None = None, within: bool = False, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that holds repeated text: doc_id, other_ids (where its repeats come first, ascending, without its own
    id), n_repeated_bytes, and spans: {at, size, n_words, first_doc_id, n_places} in the document's UTF-8 bytes, ascending.

    Neighbouring repeated chunks make one span. n_words counts its words and those on both sides that another document has too (the
    least or the greatest id that holds the span's first or last chunk; REACH words at most); a span counts from min_words on, or, where min_bytes is given, from so many bytes of whole chunks. The first occurrence is reported like the others; n_places
    tells how many the commonest chunk of a span has, first_doc_id the least id that holds any of it. Null and empty texts, and texts
    without repeats, give no row; rows repeated under one id are one document, and give a row for each different text; a null id gives none
    and doesn't count as another document; an empty table gives an empty table. Text that only one id holds, however often, counts with
    within=True only.

    Counts are added up by digest after a partial sum in each task, then joined back by digest; that join is an equi-join which
    adaptive execution may split where a passage is very common. A document's spans are put together from its own chunks."""
    chunks = written(chunk_documents(docs, id_col, text_col, _repeated_slots(docs, within, id_col, text_col)), "chunks")
    side = F.struct("doc_id", "before", "after")
    seen = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(side).alias("low"), F.max(side).alias("high"))
    seen = written(seen.where("n > 1" if within else "low.doc_id < high.doc_id"), "seen")
    hit = chunks.join(seen, "digest")
    common = [_shared(F.col(side), *[F.when(F.col(f"{o}.doc_id") != F.col("doc_id"), F.col(f"{o}.{side}")) for o in ("low", "high")]).alias(side) for side in ("before", "after")]
    hit = hit.select("doc_id", "th", "at", "size", "words", F.col("low.doc_id").alias("first"), "n", *common)
    own = hit.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("at", "size", "words", "first", "n", "before", "after"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("at", pa.int64()), ("size", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64()), ("n_places", pa.int64())])
        for batch in batches:
            ids, others, total, spans = [], [], [], []
            for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made, firsts = _spans(found, min_bytes, min_words)
                if made:
                    ids.append(doc_id)
                    others.append(sorted(firsts - {doc_id}))
                    total.append(sum(m["size"] for m in made))
                    spans.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(others, type=pa.list_(pa.int64())), pa.array(total, type=pa.int64()), pa.array(spans, type=pa.list_(place))], names=["doc_id", "other_ids", "n_repeated_bytes", "spans"])

    schema = "doc_id long, other_ids array<long>, n_repeated_bytes long, spans array<struct<at:long,size:long,n_words:long,first_doc_id:long,n_places:long>>"
    return map_batches(own.select("doc_id", "chunks"), run, schema)


def _shared(mine: Column, *others: Column) -> Column:
    """How many words on a side are the same in one of the others, from the chunk on."""

    @F.pandas_udf("int")
    def count(mine: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        none = bytes(REACH)
        a, *rest = (np.frombuffer(b"".join(none if x is None else x for x in s), np.uint8).reshape(-1, REACH) for s in (mine, low, high))
        same = [np.concatenate(((a == b) & (a > 0), np.zeros((len(a), 1), dtype=bool)), axis=1).argmin(axis=1) for b in rest]
        return pd.Series(np.maximum(*same).astype(np.int32))

    return count(mine, *others)


def _spans(found: list[dict], min_bytes: int | None, min_words: int) -> tuple[list[dict], set[int]]:
    made, firsts = [], set()
    k = 0
    while k < len(found):
        first = last = found[k]
        end, words, own, n = first["at"], 0, set(), 0
        while k < len(found) and found[k]["at"] <= end:
            last = found[k]
            end = max(end, last["at"] + last["size"])
            words += last["words"]
            own.add(last["first"])
            n = max(n, last["n"])
            k += 1
        at = first["at"]
        if min_bytes is None and words + 2 * REACH >= min_words:
            words += first["before"] + last["after"]
        if words >= min_words if min_bytes is None else end - at >= min_bytes:
            made.append({"at": at, "size": end - at, "n_words": words, "first_doc_id": min(own), "n_places": n})
            firsts |= own
    return made, firsts
