"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k least distinct 64-bit hashes of a text's shingles, ascending. Sketches of parts merge into that of the whole; two of
them estimate resemblance and containment, one the number of distinct shingles. Below k shingles all of this is exact."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, map_batches, range_bounds, text_of, utf8

K, WORDS = 256, 5
_SPAN = float(1 << 64)
#: Bytes of text in a range of ids, and the most ranges (their bounds are held on the driver).
RANGE_BYTES, MOST_RANGES = 16_000_000, 20_000


class _Hashes(dict):
    """Hashes of words met so far; starts anew when full, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Hashes()


def shingle_hashes(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """A 64-bit hash for each run of k words (all words, where there are fewer): word hashes under position factors, then mixed."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        z = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            z = z * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def sketch(words: list[bytes], k: int = K, n_words: int = WORDS) -> np.ndarray:
    h = shingle_hashes(words, n_words)
    if len(h) > 8 * k:  # the least k distinct hashes are among the least few, unless repeats crowd them out
        low = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union; parts must have been made with at least this k."""
    parts = list(parts)
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, dtype=np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; two empty texts are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    last = np.append(~twice, True)
    union = both[last]
    if len(union) <= k:
        return float(np.count_nonzero(twice) / len(union))
    return float(np.count_nonzero(twice & (both[1:] <= union[k - 1])) / k)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / _SPAN)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    union = distinct_count(merge((a, b), k), k)
    return min(1.0, resemblance(a, b, k) * union / max(1.0, distinct_count(a, k)))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode("ascii")


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype=">u8").astype(np.uint64)


def sketch_documents(docs: DataFrame, k: int = K, n_words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each whole text. Null text: the empty sketch; repeated rows: each its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [to_text(sketch(ascii_words(t), k, n_words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), utf8(made)], names=["doc_id", "fingerprint"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, "doc_id long, fingerprint string")


def merge_groups(sketched: DataFrame, group: str, k: int = K, fanout: int = 64) -> DataFrame:
    """group, fingerprint, n_distinct: the sketch of each group's union of `fingerprint` rows. Sketches are merged in `fanout` salted
    parts first, so that a task holds one running sketch of k hashes and never a whole group. A null group is a group of its own; repeated
    sketches change nothing; a null fingerprint is that of no text; an empty table gives an empty table; other columns play no part."""

    kind = dict(sketched.dtypes)[group]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: dict = {}
        for f in frames:
            for g, s in zip(f[group], f["fingerprint"], strict=True):
                key = None if pd.isna(g) else g
                own = from_text(s or "")
                run[key] = merge((run[key], own), k) if key in run else own[:k]
                if len(run) > 4096:
                    yield pd.DataFrame({group: pd.Series(list(run), dtype=f[group].dtype), "fingerprint": [to_text(v) for v in run.values()]})
                    run = {}
        if run:
            yield pd.DataFrame({group: list(run), "fingerprint": [to_text(v) for v in run.values()]})

    part = sketched.select(group, "fingerprint").mapInPandas(fold, f"`{group}` {kind}, fingerprint string")
    salted = part.repartition(group, F.pmod(F.xxhash64("fingerprint"), F.lit(fanout)))
    part = salted.mapInPandas(fold, f"`{group}` {kind}, fingerprint string")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merge([from_text(s) for s in pdf["fingerprint"]], k)
        return pd.DataFrame({group: pdf[group].iloc[:1], "fingerprint": [to_text(out)], "n_distinct": [distinct_count(out, k)]})

    return part.groupBy(group).applyInPandas(last, f"`{group}` {kind}, fingerprint string, n_distinct double")


def edited(text: str, after: str) -> str:
    """The last quarter of the code points, replaced by the first as many (or all) of the text after it."""
    m = len(text) // 4
    return text[: len(text) - m] + after[:m]


def with_neighbours(docs: DataFrame, k: int = K, n_words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next over ascending doc_id.

    Documents are dealt into ranges of doc_id, about RANGE_BYTES of text each, and sorted within them; the first document of each range is also sent to the end of the
    range before it (that of the lowest to the end of the highest), so each text travels once and no task sees more than its range.

    Null text is empty; a null id comes first; rows repeated under one id follow each other by text; a lone document is its own next;
    an empty table gives an empty table."""

    spark = docs.sparkSession
    low = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"), text_of().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cuts = np.array(range_bounds(rows, "key", max(n, min(MOST_RANGES, size // RANGE_BYTES))), dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    firsts = {r["p"]: r["k"] for r in rows.select("key").groupBy(part_of("key").alias("p")).agg(F.min("key").alias("k")).collect()}  # one for each range
    parts = sorted(firsts)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, keys.to_numpy(dtype=np.int64), side="right").tolist()
        return pd.Series([[2 * p, 2 * before[p] + 1] if firsts[p] == key else [2 * p] for p, key in zip(at, keys.tolist(), strict=True)])

    dealt = rows.withColumn("place", F.explode(places("key")))
    dealt = dealt.withColumn("part", F.shiftright("place", 1)).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("place", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, sketch of the document that waits for its next
        part = None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for place, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if place >> 1 != part:
                    part, held = place >> 1, None
                own = sketch(ascii_words(text), k, n_words)
                if held is not None:
                    old_id, old, old_sketch = held
                    new = edited(old, text)
                    new_sketch = sketch(ascii_words(new), k, n_words)
                    row = (old_id, len(old), hashlib.sha256(new.encode()).hexdigest(), to_text(old_sketch), to_text(new_sketch), resemblance(old_sketch, new_sketch, k), resemblance(old_sketch, own, k))
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                held = None if place & 1 else (doc_id, text, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(dealt.select("place", "doc_id", "text"), run, schema)
