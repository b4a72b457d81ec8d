"""A stream of changes to the files below a folder, as a data source: files that appear, change or go.

The stream's offset is the number of a listing (rel, mtime, size), kept as Parquet in a `state` folder that driver and executors share; a batch
is the difference of two listings. Files are read in tasks. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import MAX_BYTES, MAX_DEPTH

#: Files of a task at most.
FILES = 64
LISTING = pa.schema([("rel", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])


@dataclass
class Some(InputPartition):
    """(rel, kind, mtime, size, start) of some files; `start` is the byte from which a file is read."""

    changes: list[tuple[str, str, int, int, int]]


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
    return fs, path.rstrip("/")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kept = options["path"], options["state"]
        self.pattern, self.tail = re.compile(options.get("pattern", r"(?i)\.jsonl$")), options.get("tail", "false") == "true"

    def _listings(self) -> dict[int, str]:
        fs, path = _folder(self.kept)
        fs.create_dir(path, recursive=True)
        found = fs.get_file_info(pafs.FileSelector(path))
        return {int(m[1]): f.path for f in found if (m := re.fullmatch(r"listing-(\d+)\.parquet", f.base_name))}

    def _read_listing(self, n: int) -> dict[str, tuple[int, int]]:
        if n == 0:
            return {}
        fs, path = _folder(self.kept)
        t = pq.read_table(f"{path}/listing-{n:012d}.parquet", filesystem=fs).to_pydict()
        return dict(zip(t["rel"], zip(t["mtime"], t["size"])))

    def _now(self) -> dict[str, tuple[int, int]]:
        """Files level by level, no deeper than the greatest depth that is read."""
        fs, top = _folder(self.root)
        out, level = {}, [top]
        for _ in range(MAX_DEPTH):
            below = []
            for folder in level:
                for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                    if f.type == pafs.FileType.Directory:
                        below.append(f.path)
                    elif f.type == pafs.FileType.File and self.pattern.search(rel := f.path[len(top) + 1 :]) and f.size <= MAX_BYTES:
                        out[rel] = (f.mtime_ns or 0, f.size)
            level = below
        return out

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        known = max(self._listings(), default=0)
        now = self._now()
        if now == self._read_listing(known):
            return {"listing": known}
        fs, path = _folder(self.kept)
        rows = sorted((r, m, s) for r, (m, s) in now.items())
        t = pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(LISTING)], schema=LISTING)
        pq.write_table(t, f"{path}/_{known + 1}", filesystem=fs)
        fs.move(f"{path}/_{known + 1}", f"{path}/listing-{known + 1:012d}.parquet")
        return {"listing": known + 1}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        before, after = self._read_listing(start["listing"]), self._read_listing(end["listing"])
        changes = [(r, "remove", *before[r], 0) for r in sorted(before.keys() - after.keys())]
        for r, (mtime, size) in sorted(after.items()):
            if r not in before:
                changes.append((r, "create", mtime, size, 0))
            elif before[r] != (mtime, size):
                changes.append((r, "modify", mtime, size, before[r][1] if self.tail and size > before[r][1] else 0))
        return [Some(changes[k : k + FILES]) for k in range(0, len(changes), FILES)]

    def read(self, partition: Some) -> Iterator[tuple]:
        fs, top = _folder(self.root)
        for rel, kind, mtime, size, start in partition.changes:
            value = None
            if kind != "remove":
                try:
                    with fs.open_input_file(f"{top}/{rel}") as f:
                        value = f.read_at(size - start, start)  # as it was when listed
                except FileNotFoundError:
                    continue  # gone meanwhile: the next listing says so
            yield rel, kind, mtime // 1000, size, start, value

    def commit(self, end: dict) -> None:
        fs, _ = _folder(self.kept)
        for n, path in self._listings().items():
            if n < end["listing"]:
                fs.delete_file(path)


class FileChanges(DataSource):
    """format("file_changes") with options path, state, pattern, and tail: only what a grown file has more."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "rel string, kind string, mtime_micros bigint, size bigint, start bigint, value binary"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def file_changes(spark: SparkSession, folder: str, state: str, pattern: str = r"(?i)\.jsonl$", tail: bool = False) -> DataFrame:
    """A stream of (rel, kind, mtime_micros, size, start, value): kind is create, modify or remove; value the bytes from `start` on, null of a file that is gone.

    A file is whole (start 0) unless `tail` is set and it has grown. Files over the size cap aren't listed.
    """
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").options(path=folder, state=state, pattern=pattern, tail=str(tail).lower()).load()
