"""Readers: CSV, JSON lines, Parquet, arrays in NumPy files, sample shards in tar files, file listings, and what is left to fetch."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import tarfile
import time
import urllib.error
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PRODUCTS = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("catalog_content", T.StringType()), T.StructField("image_link", T.StringType()), T.StructField("price", T.DoubleType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """With a header, quoted line breaks and doubled quotes. Give a schema: without one everything is text, never inferred."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (r.schema(schema) if schema is not None else r).csv(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By the path's ending: .parquet, .json, .jsonl, anything else as CSV."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return spark.read.schema(schema).json(path, multiLine=True) if schema is not None else spark.read.json(path, multiLine=True)
    return read_csv(spark, path, schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_required(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_any(spark, path, schema)


def first_existing(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame | None:
    """The first path that is there; None if none is."""
    found = next((p for p in paths if exists(spark, p)), None)
    return None if found is None else read_any(spark, found, schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Lines that aren't JSON are skipped."""
    r = spark.read.option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema is not None else r).json(path)


def parse_jsonl(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same on a column: parsed fields, and `bad` where a line isn't what the schema says."""
    made = lines.withColumn("_p", F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return made.withColumn("bad", F.coalesce(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), F.lit(True))).select("*", "_p.*").drop("_p", "_corrupt")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, embedding of .npz files with arrays of these names; a file is decoded where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with np.load(io.BytesIO(content)) as z:
                    ids, emb = z["sample_id"].astype(np.int64), z["embedding"].astype(np.float32)
                for a in range(0, len(ids), 4096):
                    part = emb[a : a + 4096]
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1] or 1, dtype=np.int32)), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 4096]), rows], names=["sample_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sample_id long, embedding array<float>")


def read_npy(spark: SparkSession, path: str, dims: int = 2, names: str | None = None) -> DataFrame:
    """path, shape, values of .npy files; a file of another number of dimensions gives an error text instead. names: a pattern of names in the
    folder `path`, which is listed once; of a path with wildcards, Spark lists every file that it stands for on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                    rows.append((name, list(a.shape), a.reshape(-1).astype(float).tolist(), None) if a.ndim == dims else (name, list(a.shape), None, f"{a.ndim} dimensions"))
                except (ValueError, EOFError) as e:
                    rows.append((name, None, None, str(e)))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["path", "shape", "values", "error"])

    r = spark.read.format("binaryFile")
    files = (r if names is None else r.option("pathGlobFilter", names)).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, shape array<long>, values array<double>, error string")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of all files below a folder, empty ones too (Spark's file sources leave those out). The driver asks the file system
    for names and sizes, as it does for any read; contents aren't touched."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found, rows = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(rows, "path string, length long")


def list_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """path, length of files with these endings, in any case."""
    return listing(spark, folder).where(F.lower("path").rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).where("length = 0").select("path").orderBy("path")


def fetchable(link: Column) -> Column:
    return F.coalesce(link.startswith("http"), F.lit(False))


def to_fetch(rows: DataFrame, link: str, have: DataFrame, name: str) -> DataFrame:
    """Distinct links still to be fetched: http links whose file name isn't there."""
    from larkmill.functions.extract import url_filename

    wanted = rows.where(fetchable(F.col(link))).select(F.col(link).alias("link")).distinct().withColumn("name", url_filename(F.col("link")))
    return wanted.join(have.select(F.col(name).alias("name")), "name", "left_anti").select("link", "name")


def fetch(links: DataFrame, get: Callable[[str], bytes], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """link, ok, detail, content of each row's `link` through `get`, which returns bytes or raises as urllib does. What isn't there (404)
    is asked once, anything else `tries` times with a pause that grows by `wait` seconds. An answer of no bytes counts as a failure.
    detail: ok, empty, 404, HTTP and the status, URL error and its reason, or the exception's name; a null link gives `no link`.
    Deal the links into partitions first (to_fetch gives distinct ones): a partition's links are asked one after the other."""

    def one(link: str | None) -> tuple:
        if link is None:
            return False, "no link", None
        detail = ""
        for turn in range(tries):
            if turn:
                time.sleep(wait * turn)
            try:
                content = get(link)
            except urllib.error.HTTPError as e:
                detail = "404" if e.code == 404 else f"HTTP {e.code}"
            except urllib.error.URLError as e:
                detail = f"URL error: {e.reason}"
            except Exception as e:  # any fault of one link is that link's outcome
                detail = type(e).__name__
            else:
                if content:
                    return True, "ok", content
                detail = "empty"
            if detail == "404":
                break
        return False, detail, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for link in batch.column(0).to_pylist():
                ok, detail, content = one(link)
                yield pa.RecordBatch.from_arrays([pa.array([link], pa.string()), pa.array([ok]), pa.array([detail]), pa.array([content], pa.binary())], names=["link", "ok", "detail", "content"])

    return links.select("link").mapInArrow(run, "link string, ok boolean, detail string, content binary")


def braces(pattern: str) -> list[str]:
    """{000..067} stands for all numbers between, both ends included, with the first one's width."""
    found = re.search(r"\{(\d+)\.\.(\d+)\}", pattern)
    if not found:
        return [pattern]
    first, last = found[1], found[2]
    return [p for i in range(int(first), int(last) + 1) for p in braces(f"{pattern[: found.start()]}{i:0{len(first)}d}{pattern[found.end() :]}")]


@dataclass
class Stretch(InputPartition):
    """Samples of an archive that begin from byte `start` on and before `end`."""

    path: str
    start: int
    end: int


@dataclass
class Bundle(InputPartition):
    """What one task reads."""

    stretches: list[Stretch]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it: local paths and every address that pyarrow knows (hdfs, s3, gs and so on), no mounting needed."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _matching(store: pafs.FileSystem, pattern: str, seen: dict[tuple[str, int], dict[str, list[pafs.FileInfo]]]) -> list[pafs.FileInfo]:
    """Files by a pattern in the last part of their name, sorted. seen keeps folders that were listed, their files by what follows a pattern's
    last wildcard, so that many patterns of a brace range don't all go through the whole folder."""
    folder, _, name = pattern.rpartition("/")
    if not re.search(r"[*?\[]", name):
        found = store.get_file_info(pattern)
        return [found] if found.type == pafs.FileType.File else []
    end = re.split(r"[*?\[\]]", name)[-1]
    at = folder, len(end)
    if at not in seen:
        seen[at] = {}
        for f in sorted(store.get_file_info(pafs.FileSelector(folder or "/", allow_not_found=True)), key=lambda f: f.path):
            if f.type == pafs.FileType.File:
                seen[at].setdefault(f.path[len(f.path) - len(end) :], []).append(f)
    return [f for f in seen[at].get(end, []) if fnmatch.fnmatchcase(f.base_name, name)]


#: Tasks before archives share one, and tasks in all: each costs the driver memory for what it reads and for its result.
APART, TASKS = 200, 2000


def bundled(stretches: list[Stretch], most: int, apart: int = APART, tasks: int = TASKS) -> list[Bundle]:
    """Neighbours together, `most` bytes at most if there are several, where there are more than `apart` of them; `apart` bundles at least stay. Of
    very many stretches, more bytes go to a task, so that about `tasks` are left, twice as many at most; neighbours in an archive become one stretch."""
    if len(stretches) <= apart:
        return [Bundle([x]) for x in stretches]
    whole = sum(x.end - x.start for x in stretches)
    most = min(most, whole // apart)
    if len(stretches) > tasks:
        most = max(most, whole // tasks)
    out, size = [], 0
    for x in stretches:
        if not out or size + x.end - x.start > most:
            out.append(Bundle([]))
            size = 0
        size += x.end - x.start
        own = out[-1].stretches
        if own and own[-1].path == x.path and own[-1].end == x.start:
            own[-1] = Stretch(x.path, own[-1].start, x.end)
        else:
            own.append(x)
    return out


def sample_starts(file) -> list[int]:
    """Places in an open archive at which a sample's first member begins. Only headers are read. A broken archive gives what comes before."""
    starts, last = [], None
    try:
        with tarfile.open(fileobj=file, mode="r:") as tar:
            for m in tar:
                own = m.name.partition(".")[0]
                if own != last:
                    starts.append(m.offset)
                last = own
                tar.members = []  # or it keeps every header
    except (tarfile.TarError, EOFError):
        pass
    return starts


class TarReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int = 64 << 20):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        """One for each archive, or for each stretch of split_bytes of a larger one, which begins and ends between samples: by the index beside
        it (name.idx, which the writer leaves), else by its headers. Of very many small ones, several go to a task. Names in a brace range that
        aren't there are warned about and left out."""
        out, seen = [], {}
        for pattern in braces(self.path):
            store, own = opened(pattern)
            found = _matching(store, own, seen)
            if not found:
                warnings.warn(f"no shard {pattern}", stacklevel=2)
            base = pattern[: len(pattern) - len(own)]
            for f in found:
                cuts = [0, *self._cuts(store, f.path), f.size] if f.size > self.split_bytes else [0, f.size]
                out += [Stretch(base + f.path, a, b) for a, b in pairwise(cuts)]
        return bundled(out, self.split_bytes)

    def _cuts(self, store: pafs.FileSystem, path: str) -> list[int]:
        if store.get_file_info(f"{path}.idx").type == pafs.FileType.File:
            with store.open_input_stream(f"{path}.idx") as f:
                starts = json.loads(f.read())
        else:
            with store.open_input_file(path) as f:
                starts = sample_starts(f)
        cuts, last = [], 0
        for at in starts:
            if at - last >= self.split_bytes:
                cuts.append(at)
                last = at
        return cuts

    def read(self, partition: Bundle) -> Iterator[tuple]:
        for stretch in partition.stretches:
            yield from self._samples(stretch)

    def _samples(self, partition: Stretch) -> Iterator[tuple]:
        """Members of a sample lie together; a broken archive ends its shard, not the job."""
        key, parts = None, {}
        store, path = opened(partition.path)
        name = partition.path.removeprefix("file://")
        try:
            with store.open_input_file(path) as file:
                file.seek(partition.start)
                with tarfile.open(fileobj=file, mode="r:") as tar:
                    for m in tar:
                        if m.offset >= partition.end:
                            break
                        own, _, ending = m.name.partition(".")
                        if key is not None and own != key:
                            yield name, key, parts
                            parts = {}
                        key = own
                        f = tar.extractfile(m)
                        parts[ending] = f.read() if f else b""
                        tar.members = []
        except (tarfile.TarError, EOFError) as e:
            warnings.warn(f"shard {partition.path} is broken: {e}", stacklevel=2)
            return
        if key is not None:
            yield name, key, parts


class TarSource(DataSource):
    """spark.dataSource.register(TarSource); format("tarshards"): shard, key, parts (ending to content) of sample archives, which tasks open through
    pyarrow's file systems. Option split_bytes (64 MB): larger archives are read by several tasks."""

    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return "shard string, key string, parts map<string, binary>"

    def reader(self, schema: T.StructType) -> TarReader:
        return TarReader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))
