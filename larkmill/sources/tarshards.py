"""Sample shards as tar archives: the writing half of the tarshards data source."""

from __future__ import annotations

import io
import json
import os
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .readers import TarSource


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]
    samples: int
    skipped: int


class TarWriter(DataSourceWriter):
    """key, parts (ending to content) as members key.ending; `per_shard` samples an archive. A sample that lacks one of the `needs`
    endings is skipped. Archives get their final names when all tasks are through."""

    def __init__(self, path: str, per_shard: int, needs: list[str]):
        self.path, self.per_shard, self.needs = path, per_shard, needs

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part, files, tar, n, samples, skipped, starts = TaskContext.get().partitionId(), [], None, 0, 0, 0, []
        for row in rows:
            if any(e not in row["parts"] for e in self.needs):
                skipped += 1
                continue
            if tar is None or n >= self.per_shard:
                if tar is not None:
                    self._close(tar, files[-1], starts)
                name = f"shard-{part:06d}-{len(files):06d}.tar"
                temp = f"{self.path}/.{name}.{uuid.uuid4().hex}"
                files.append((temp, f"{self.path}/{name}"))
                tar, n, starts = tarfile.open(temp, "w"), 0, []
            starts.append(tar.offset)
            for ending, content in sorted(row["parts"].items()):
                info = tarfile.TarInfo(f"{row['key']}.{ending}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(bytes(content)))
                tar.members = []  # or it keeps every header
            n += 1
            samples += 1
        if tar is not None:
            self._close(tar, files[-1], starts)
        return Written(files, samples, skipped)

    def _close(self, tar: tarfile.TarFile, names: tuple[str, str], starts: list[int]) -> None:
        """Ends an archive and leaves its index, the places where samples begin, beside it."""
        tar.close()
        with open(f"{names[0]}.idx", "w") as f:
            json.dump(starts, f)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temp, name in m.files if m else []:
                os.replace(f"{temp}.idx", f"{name}.idx")
                os.replace(temp, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temp, _ in m.files if m else []:
                for path in (temp, f"{temp}.idx"):
                    if os.path.exists(path):
                        os.remove(path)


class TarShards(TarSource, DataSource):
    """spark.dataSource.register(TarShards): reads as TarSource and writes with options path, per_shard (1000) and needs (a comma list).
    The folder must be one that the driver and all executors share."""

    def writer(self, schema: T.StructType, overwrite: bool) -> TarWriter:
        needs = [e for e in self.options.get("needs", "").split(",") if e]
        return TarWriter(self.options["path"].removeprefix("file://"), int(self.options.get("per_shard", "1000")), needs)
