"""How five quality filters act together: what each removes in every order of application.

Each document becomes five bits, one for each filter that it fails. A table of 32 rows by 120 orders, made once, says at which step an
order removes a document with these bits; np.bincount counts those steps by part, and the counts of all tasks are summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, map_batches, text_of, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The filter (0 to 4) at each step of each order.
AT = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
#: FIRST[bits, order]: the first step whose filter the bits fail, STEPS where none does.
FIRST = np.array([[next((s for s in range(STEPS) if bits >> AT[o, s] & 1), STEPS) for o in range(len(ORDERS))] for bits in range(2**STEPS)])
#: Rows counted at once, and parts whose counts a task holds before it hands them on.
ROWS, PARTS = 8192, 128
COUNTS = ("docs", "gone", "removed", "fails", "unique_fails", "good_lost", "toxic_lost", "shapley")

MARKS = b"#$%&*|"


def text_bits(text: bytes, n_chars: int, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2) -> int:
    """Bits 1, 2, 4, 8 for the filters A (few words), B (repeated words), C (capitals), D (marks)."""
    words = text.split()  # bytes split at exactly space, \t, \n, \v, \f, \r
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marked = len(text) != len(text.translate(None, MARKS))
    return (len(words) < least_words) | (100 * len(set(words)) < least_distinct * len(words)) << 1 | (100 * capitals > most_capitals * n_chars) << 2 | marked << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts, texts, sizes = batch.columns
        bits, digests = [], []
        for text, n in zip(texts.cast(pa.binary()), sizes.to_pylist(), strict=True):
            own = text.as_py()
            bits.append(text_bits(own, n))
            digests.append(hashlib.blake2b(own, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([ids, parts, pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "bits", "digest"])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, bits (0 to 31), good, toxic: one row for each row of docs.

    Bit E: a smaller id has an identical text (128-bit digests), whatever other filters say. A null id is never a smaller one and
    never a later copy; rows repeated under one id don't make each other copies. A document that several label rows name is good, or toxic,
    if one of them says so; one without labels is neither."""
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text_of(f"`{text_col}`").alias("text"))
    read = read.withColumn("n", F.char_length("text"))
    rows = written(map_batches(read, _judge, "id long, part string, bits int, digest binary"), "audit-bits")
    # both written: the joins below have plain exchanges on both sides, which adaptive execution can split at a hot text
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "audit-firsts")
    named = labels.where(f"`{id_col}` IS NOT NULL").groupBy(F.col(f"`{id_col}`").cast("long").alias("lid"))
    named = written(named.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "audit-labels")
    out = rows.join(firsts, "digest", "left").select("id", "part", (F.col("bits") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).cast("int").alias("bits"))
    out = out.join(named, F.col("id") == F.col("lid"), "left")
    return out.select("part", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def step_counts(codes: np.ndarray, bits: np.ndarray, n_parts: int) -> np.ndarray:
    """[part, order, step]: rows of each part that each order removes at each step; the last step is "never"."""
    n_orders, width = len(ORDERS), STEPS + 1
    place = (codes[:, None] * n_orders + np.arange(n_orders)) * width + FIRST[bits]
    return np.bincount(place.ravel(), minlength=n_parts * n_orders * width).reshape(n_parts, n_orders, width)


def _counts(codes: np.ndarray, bits: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
    """[part, order, step, count in the order of COUNTS]."""
    out = np.zeros((n, len(ORDERS), STEPS, len(COUNTS)), dtype=np.int64)
    every = step_counts(codes, bits, n)
    removed = every[..., :STEPS]
    by_bits = np.bincount(codes * 2**STEPS + bits, minlength=n * 2**STEPS).reshape(n, -1)
    failing = np.stack([by_bits[:, [b for b in range(2**STEPS) if b >> f & 1]].sum(axis=1) for f in range(STEPS)], axis=1)
    only = by_bits[:, [1 << f for f in range(STEPS)]]
    shapley = np.stack([(removed * (AT == f)).sum(axis=(1, 2)) for f in range(STEPS)], axis=1)
    out[..., 0] = by_bits.sum(axis=1)[:, None, None]
    out[..., 1] = removed.cumsum(axis=2)
    out[..., 2] = removed
    out[..., 3], out[..., 4], out[..., 7] = failing[:, AT], only[:, AT], shapley[:, AT]
    for at, mark in ((5, good), (6, toxic)):
        if (own := mark > 0).any():
            out[..., at] = step_counts(codes[own], bits[own], n)[..., :STEPS]
    return out


def _rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = list(held)
    for at in range(0, len(names), 32):
        some = names[at : at + 32]
        table = np.concatenate([held[p].reshape(-1, len(COUNTS)) for p in some])
        each = len(ORDERS) * STEPS
        parts = pa.array(np.repeat(np.arange(len(some)), each)), pa.array(some, pa.string())
        orders = pa.array(np.tile(np.repeat(np.arange(len(ORDERS), dtype=np.int32), STEPS), len(some)))
        steps = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS) * len(some)))
        yield pa.RecordBatch.from_arrays([parts[1].take(parts[0]), orders, steps, *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(COUNTS))]], names=["part", "nr", "step", *COUNTS])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in gathered(batches, ROWS):
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            coded = some.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            bits, good, toxic = (some.column(i).to_numpy() for i in (1, 2, 3))
            for low in range(0, len(names), PARTS):  # a few parts at a time, however many a batch has
                own = (codes >= low) & (codes < low + PARTS)
                now = _counts(codes[own].astype(np.int64) - low, bits[own], good[own], toxic[own], min(PARTS, len(names) - low))
                for name, table in zip(names[low : low + PARTS], now, strict=True):
                    held[name] = held[name] + table if name in held else table
                if len(held) > PARTS:
                    yield from _rows(held)
                    held = {}
    yield from _rows(held)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part that docs
    have, every order of the five filters and every step; docs: the part's rows.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 2 % of the characters are A-Z. D: a mark of #$%&*|. E: a copy of a
    smaller id's text. Null texts are empty ones; a null part is the empty string; nulls, copies and labels are as in `judged`. An empty table
    gives no rows; other columns of docs and labels play no part. A task holds counts of PARTS parts, whatever the number of rows; a part with a third of
    all rows is one partial sum for each task."""
    rows = judged(docs, labels, id_col, text_col, part_col)
    partial = map_batches(rows, _tally, f"part string, nr int, step int, {', '.join(f'{c} long' for c in COUNTS)}")
    total = partial.groupBy("part", "nr", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("nr") + 1)
    total = total.select("part", order.alias("filter_order"), "step", *COUNTS)
    return total.select("part", "filter_order", "step", F.substr("filter_order", F.col("step"), F.lit(1)).alias("filter"), "docs", (F.col("docs") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
