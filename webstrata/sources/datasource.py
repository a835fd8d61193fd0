"""``spark.read.format("wrr")`` and ``readStream``: archives as a Spark data source.

Register it with ``register(spark)``. Files are grouped into partitions of about ``partitionBytes``; a
partition is read as Arrow batches. Conditions on ``source_path`` choose files before any is opened
(with ``spark.sql.python.filterPushdown.enabled``). A stream takes files in order of their time and name, each once.

The folder has to be mounted where driver and executors run, as Python opens the files. For stores that only
Spark's readers reach there is ``wrr.read``, which gives the same rows.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webstrata.schema import EXCHANGE
from webstrata.sources import wrr

PARTITION_BYTES, BATCH_ROWS = 64 << 20, 500


@dataclass(frozen=True)
class _File:
    path: str
    size: int
    at: int

    @staticmethod
    def of(path: str) -> _File:
        found = os.stat(path)
        return _File(path, found.st_size, found.st_mtime_ns)


@dataclass
class _Files(InputPartition):
    files: tuple[_File, ...]


def _hide(folders: list[str]) -> None:
    """Do not walk into folders of names that Spark hides."""
    folders[:] = [f for f in folders if f[:1] not in "._"]


def _found(options: dict) -> list[_File]:
    """Files below the path, those still being written left out."""
    top = options["path"].removeprefix("file://").removeprefix("file:")
    if os.path.isfile(top):
        return [_File.of(top)]
    names = [os.path.join(folder, name) for folder, folders, files in os.walk(top) if not _hide(folders) for name in files if name[:1] not in "._"]
    glob = options.get("pathglobfilter", "*")
    return sorted((_File.of(n) for n in names if not n.endswith(".part") and fnmatch.fnmatchcase(os.path.basename(n), glob)), key=lambda f: f.path)


def _grouped(files: list[_File], most: int) -> list[_Files]:
    out, held, size = [], [], 0
    for file in files:
        if held and size + file.size > most:
            out.append(_Files(tuple(held)))
            held, size = [], 0
        held.append(file)
        size += file.size
    return [*out, _Files(tuple(held))] if held else out


def _batches(part: _Files, loader: str, errors: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    for file in part.files:
        if _File.of(file.path) != file:
            raise ValueError(f"{file.path} has changed")
        with open(file.path, "rb") as opened:
            rows = wrr._rows(file.path, opened.read(), loader)
        while some := list(islice(rows, BATCH_ROWS)):
            bad = [r for r in some if r["error"] is not None]
            if bad and errors == "fail":
                raise ValueError(f"cannot load {file.path}: {bad[0]['error']}")
            if errors == "ignore":
                some = [r for r in some if r["error"] is None]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in some], schema=arrow)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = getattr(f, "attribute", None) == ("source_path",)
            if own and isinstance(f, EqualTo):
                self.tests.append(lambda p, v=f.value: p == v)
            elif own and isinstance(f, In):
                self.tests.append(lambda p, v=frozenset(f.value): p in v)
            elif own and isinstance(f, StringStartsWith):
                self.tests.append(lambda p, v=f.value: p.startswith(v))
            elif own and isinstance(f, StringEndsWith):
                self.tests.append(lambda p, v=f.value: p.endswith(v))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        files = [f for f in _found(self.options) if all(t(f.path) for t in self.tests)]
        self.tests = []  # they are done with, and are not sent to the tasks
        return _grouped(files, int(self.options.get("partitionbytes", PARTITION_BYTES))) or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.get("loader", "auto"), self.options.get("errors", "fail"), self.schema)


class _Stream(DataSourceStreamReader):
    """The offset is time and name of the last file that was taken."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def _after(self, offset: dict) -> list[_File]:
        since = (offset["at"], offset["path"])
        return sorted((f for f in _found(self.options) if (f.at, f.path) > since), key=lambda f: (f.at, f.path))

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._after(self.initialOffset())
        return {"at": files[-1].at, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        files = [f for f in self._after(start) if (f.at, f.path) <= (end["at"], end["path"])]
        return _grouped(files, int(self.options.get("partitionbytes", PARTITION_BYTES))) or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.get("loader", "auto"), self.options.get("errors", "fail"), self.schema)

    def commit(self, end: dict) -> None:
        pass


class WrrSource(DataSource):
    """Options: path, loader (auto, wrr, wrrb, some), errors (fail, skip, ignore), pathGlobFilter, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "wrr"

    def schema(self) -> StructType:
        return EXCHANGE

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError("say where the archive is: load(path)")
        for name, known in (("loader", ("auto", "wrr", "wrrb", "some")), ("errors", ("fail", "skip", "ignore"))):
            if options.get(name, known[0]) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}")
        return options

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._options(), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self._options(), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WrrSource)
