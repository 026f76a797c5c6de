"""Token-id files: ids ranked by frequency, byte-aligned variable-length values with separate control bytes.

A file holds: magic, then little-endian counts of documents and values, then doc ids (int64), first positions in the whole corpus
(uint64), values of each document (uint64), a null mark for each doc id (uint8), control bytes (four 2-bit lengths each, lowest
first), and the values' bytes. ranks.u32 beside them maps a rank back to its id. The commonest 256 ids take one byte, the next 65,280
take two."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, map_batches, scratch_path, text_of, written
from .tokens import encoder

MAGIC = b"LKTOKEN1"
#: Bytes of text in a range of ids, and the most ranges (their bounds are held on the driver).
RANGE_BYTES, MOST_RANGES = 16_000_000, 20_000
#: Bytes of text that are encoded together: the more, the fewer look-ups of words, and the more memory.
TEXT_BYTES = 8_000_000
#: Value lengths of each control byte, and their sum.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


def pack_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of uint32 values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    n = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    quads[: len(v)] = n
    q = quads.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= n[:, None]]
    return control.astype(np.uint8), data


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values again: a table gives each control byte's four lengths, by which the bytes are laid into rows of two or four."""
    size = LENGTHS[control].reshape(-1)[:n]
    width = 2 if n and size.max() <= 2 else 4
    out = np.zeros((n, width), dtype=np.uint8)
    out[np.arange(width, dtype=np.uint8) < size[:, None]] = data
    return out.view(f"<u{width}").reshape(-1).astype("<u4", copy=False)


def file_bytes(doc_ids: list, starts: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_values(ranks)
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = np.array([len(ids), len(ranks)], dtype="<u8")
    return b"".join((MAGIC, head.tobytes(), ids.tobytes(), starts.astype("<u8").tobytes(), counts.astype("<u8").tobytes(), nulls.tobytes(), control.tobytes(), data.tobytes()))


def draft_bytes(doc_ids: list, starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
    """The same head with the plain ids, two bytes each where that is enough."""
    wide = len(values) and int(values.max()) > 0xFFFF
    head = np.array([len(doc_ids), 4 if wide else 2], dtype="<u8")
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join((head.tobytes(), ids.tobytes(), starts.astype("<u8").tobytes(), counts.astype("<u8").tobytes(), nulls.tobytes(), values.astype("<u4" if wide else "<u2").tobytes()))


def parse_draft(content: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    docs, size = np.frombuffer(content, "<u8", 2).tolist()
    ids, starts, counts = np.frombuffer(content, "<i8", docs, 16), np.frombuffer(content, "<u8", docs, 16 + 8 * docs), np.frombuffer(content, "<u8", docs, 16 + 16 * docs)
    nulls = np.frombuffer(content, np.uint8, docs, 16 + 24 * docs)
    return [None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)], starts, counts, np.frombuffer(content, f"<u{size}", -1, 16 + 25 * docs)


def parse_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, starts, counts and ranks of a file; raises ValueError where it isn't whole."""
    if content[:8] != MAGIC or len(content) < 24:
        raise ValueError("not a token file")
    docs, values = np.frombuffer(content, "<u8", 2, 8).tolist()
    at = 24
    ids = np.frombuffer(content, "<i8", docs, at)
    starts = np.frombuffer(content, "<u8", docs, at + 8 * docs)
    counts = np.frombuffer(content, "<u8", docs, at + 16 * docs)
    at += 24 * docs
    nulls = np.frombuffer(content, np.uint8, docs, at)
    control = np.frombuffer(content, np.uint8, -(-values // 4), at + docs)
    data = np.frombuffer(content, np.uint8, -1, at + docs + len(control)) if len(content) > at + docs + len(control) else np.empty(0, np.uint8)
    if int(counts.sum()) != values or len(data) != int(LENGTHS[control].sum(dtype=np.int64)) - (len(control) * 4 - values):
        raise ValueError("a token file is cut short")
    return [None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)], starts, counts, unpack_values(control, data, values)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_tokens: int = 2_000_000) -> DataFrame:
    """Write all documents' ids, each followed by end_id, in ascending doc_id order (nulls first, equal ids by text); returns the
    manifest: part, file, docs, values. Files are named by range and number, so that their names sort as their documents.

    Documents are dealt into ranges of doc_id (and, for ids that repeat or are null, of their texts' beginnings), about RANGE_BYTES of text
    each, and sorted there. Each range is streamed into draft files of about shard_tokens values with the plain ids, while every task
    counts its ids. When all counts are in, each draft is coded by the ids' ranks over all documents and removed. A file is written
    beside its place and moved there, so that a task run again finds or makes whole files only. Texts are encoded once."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(n, min(MOST_RANGES, size // RANGE_BYTES))
    dealt = docs.repartitionByRange(ranges, F.asc_nulls_first("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(path)
        encode, end = encoder(tokenizer).encode_all, int(end_id).to_bytes(4, "little")
        part, seq, held, ids, lengths, runs, begun = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        total = np.zeros(0, dtype=np.int64)

        def flush() -> list[tuple]:
            nonlocal seq, held, ids, lengths, runs, begun, total
            if not ids:
                return []
            counts, values = np.concatenate(lengths), np.concatenate(runs)
            name = f"{part:08d}-{seq:06d}"
            _put(store, base, f"{name}.draft", draft_bytes(ids, begun + np.cumsum(counts) - counts, counts, values))
            got = np.bincount(values, minlength=len(total))
            got[: len(total)] += total
            total = got
            row = (part, name, len(ids), int(counts.sum()))
            begun += row[3]
            seq, held, ids, lengths, runs = seq + 1, 0, [], [], []
            return [row]

        for batch in gathered(batches, size=TEXT_BYTES):
            values, counts = encode(batch.column(1), end)
            own, ends, rows, at = batch.column(0).to_pylist(), np.cumsum(counts), [], 0
            while at < len(own):
                before = int(ends[at] - counts[at])
                to = min(len(own), at + 1 + int(np.searchsorted(ends[at:], before + shard_tokens - held)))
                ids += own[at:to]
                lengths.append(counts[at:to])
                runs.append(values[before : ends[to - 1]])
                held, at = held + int(ends[to - 1]) - before, to
                if held >= shard_tokens:
                    rows += flush()
            yield _manifest(rows)
        yield _manifest(flush())
        yield _manifest([(-1 - int(i), None, 0, int(total[i])) for i in np.flatnonzero(total)])

    store, base = pafs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    made = written(map_batches(dealt, draft, "part int, file string, docs long, values long"), "manifest")
    freq = made.where("part < 0").groupBy((-1 - F.col("part")).alias("id")).agg(F.sum("values").alias("n")).collect()  # the vocabulary at most
    ranked = np.array([r["id"] for r in sorted(freq, key=lambda r: (-r["n"], r["id"]))] or [end_id], dtype="<u4")
    rank_of = np.zeros(int(ranked.max()) + 1, dtype="<u4")
    rank_of[ranked] = np.arange(len(ranked), dtype="<u4")
    _put(store, base, "ranks.u32", ranked.tobytes())
    manifest = made.where("part >= 0")

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if store.get_file_info(f"{base}/{name}.tok").type == pafs.FileType.NotFound:
                    with store.open_input_stream(f"{base}/{name}.draft") as f:
                        ids, starts, counts, values = parse_draft(f.read())
                    _put(store, base, f"{name}.tok", file_bytes(ids, starts, counts, rank_of[values]))
                if store.get_file_info(f"{base}/{name}.draft").type != pafs.FileType.NotFound:
                    store.delete_file(f"{base}/{name}.draft")
            yield batch

    written(map_batches(manifest.select("file").repartition(n), recode, "file string"), "recoded")
    return manifest


def _put(store: pafs.FileSystem, base: str, name: str, content: bytes) -> None:
    temp = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(content)
    store.move(temp, f"{base}/{name}")


def _manifest(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["part", "file", "docs", "values"])


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32), decoded from the files. A file holds positions within its range;
    what all lower ranges hold comes from the manifest's totals, one number for each range."""
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("values").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(totals):
        before[part] = at
        at += totals[part]
    ranked = spark.read.format("binaryFile").load(f"{path}/ranks.u32").select("content").first()
    table = np.frombuffer(bytes(ranked["content"]), dtype="<u4")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.tok").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                base = before[int(name.as_py().rsplit("/", 1)[-1].split("-")[0])]
                ids, starts, counts, ranks = parse_file(content.as_py())
                raw = table[ranks].tobytes()
                ends = np.cumsum(counts.astype(np.int64)) * 4
                blobs = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, type=pa.int64()), pa.array(starts.astype(np.int64) + base), pa.array(counts.astype(np.int64)), pa.array(blobs, type=pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return map_batches(files, run, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write and read back, with each document's CRC-32 of its ids. Null text: the end id alone; repeated rows are all written."""
    path = scratch_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
