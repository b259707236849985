"""``spark.read.format("media_folders")``: file trees as a table, also as a stream.

::

    folders.register(spark)
    spark.read.format("media_folders").load("/library").where("not excluded and path like '/library/2024/%'")

Columns are those of ``files.listing`` and ``excluded``: whether a rule leaves the entry out
by a name below its root. Filters that Spark pushes down keep the reader out of folders: a
prefix of ``path``, and ``excluded`` being false. Spark still applies them to the rows.

Roots are local paths, or addresses of stores that Arrow's file systems know
(``s3://``, ``gs://``, ``hdfs://``, ``file://``); several come as the JSON list ``roots``.
Planning opens folders until there are ``splits`` of them or none is left; a task walks the
folders of its own. One folder's entries are read in one task, a few at a time. Where one
subtree has most of all folders, ``files.listing`` deals them out better, level by level.

A root that is no folder and a folder that can't be read are rows with ``error``. A path
under two roots comes once for each. Local links are not followed. An empty folder has no
rows but that of its parent.

As a stream, each batch has the files that changed (were written, or moved in, where the
store tells) since the one before: offsets are times, so starting again with a checkpoint
goes on from there, and nothing is walked to plan a batch. A second that isn't over yet waits
for a later batch. What was deleted is not told: ``tree.changed_folders`` finds that.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, Not, StringStartsWith
from pyspark.sql.types import StructType

from mediashoal.functions import rules
from mediashoal.sources import files

SCHEMA = f"{files.ENTRY}, excluded boolean"
_LOWER = str.maketrans(rules.UPPER, rules.LOWER)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
#: Seconds for which files of the newest seconds may still be on their way.
SETTLE = 2


def _store_entries(root: str, here: str) -> Iterator[tuple]:
    """What a folder of a store holds directly, named by full addresses."""
    try:
        store, inside = arrow_fs.FileSystem.from_uri(here)
        found = sorted(store.get_file_info(arrow_fs.FileSelector(inside)), key=lambda e: e.base_name)
    except (OSError, pa.ArrowException) as e:
        yield root, here, here.rsplit("/", 1)[0], True, None, None, None, f"{here}: {e}"
        return
    for e in found:
        is_dir = e.type == arrow_fs.FileType.Directory
        changed = None if e.mtime_ns is None else e.mtime_ns // 10**9
        yield root, f"{here}/{e.base_name}", here, is_dir, None if is_dir else e.size, changed, changed, None


def _entries(root: str, here: str) -> Iterator[tuple]:
    if "://" in here:
        return _store_entries(root, here)
    if here == root and not os.path.isdir(root):
        return iter([(root, root, os.path.dirname(root), True, None, None, None, f"{root}: not a folder" if os.path.exists(root) else f"{root}: no such folder")])
    return files.entries_of(root, here)


def _left_out(name: str) -> bool:
    return name.startswith(".") or name.translate(_LOWER) in rules.EXCLUDED_NAMES


@dataclass(frozen=True)
class Pruning:
    """Where entries that are wanted can be."""

    prefixes: tuple[str, ...] = ()
    listed_only: bool = False

    def opens(self, root: str, folder: str) -> bool:
        inside = folder.rstrip("/") + "/"
        if self.listed_only and any(map(_left_out, filter(None, folder[len(root) :].split("/")))):
            return False
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)


def _is_dir(row: tuple) -> bool:
    return row[3] and row[7] is None


@dataclass
class Folders(InputPartition):
    """Folders of a task, each as (root, folder, whether those below are its too)."""

    folders: list[tuple[str, str, bool]]


def _read(folders: list[tuple[str, str, bool]], pruning: Pruning) -> Iterator[tuple]:
    todo = [*reversed(folders)]
    while todo:
        root, here, deep = todo.pop()
        for row in _entries(root, here):
            yield *row, row[1] != root and any(map(_left_out, filter(None, row[1][len(root) :].split("/"))))
            if deep and _is_dir(row) and pruning.opens(root, row[1]):
                todo.append((root, row[1], True))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [*files.NAMES, "excluded"]
    while part := [*islice(rows, 4096)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), _KINDS, strict=True)], names)


def _plan(roots: list[str], splits: int, pruning: Pruning) -> list[Folders]:
    """Folders dealt to tasks: those opened for planning are read on their own, others with all below."""
    flat, deep = [], [(r, r) for r in roots if pruning.opens(r, r)]
    while deep and len(deep) < splits and len(flat) < 4 * splits:
        opened, deep = deep, []
        for k, (root, here) in enumerate(opened):
            if len(deep) + len(opened) - k >= splits:  # enough: the rest stays whole
                deep += opened[k:]
                break
            flat.append((root, here, False))
            deep += [(root, row[1]) for row in _entries(root, here) if _is_dir(row) and pruning.opens(root, row[1])]
    every = [*[(root, here, True) for root, here in deep], *flat]
    return [Folders(every[k::splits]) for k in range(min(splits, len(every)))]


class FolderReader(DataSourceReader):
    def __init__(self, roots: list[str], splits: int):
        self.roots, self.splits, self.pruning = roots, splits, Pruning()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        prefixes, listed_only = [], False
        for f in filters:
            match f:
                case StringStartsWith(("path",), value):
                    prefixes.append(value)
                case EqualTo(("excluded",), False) | Not(EqualTo(("excluded",), True)):
                    listed_only = True
            yield f
        self.pruning = Pruning(tuple(prefixes), listed_only)

    def partitions(self) -> list[Folders]:
        return _plan(self.roots, self.splits, self.pruning)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return _batches(_read(partition.folders, self.pruning))


@dataclass
class Changes(Folders):
    """Of these folders, what changed after ``start`` and not after ``end``."""

    start: int = 0
    end: int = 0


class FolderStream(DataSourceStreamReader):
    def __init__(self, roots: list[str], splits: int):
        self.roots, self.splits = roots, splits

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int(time.time()) - SETTLE}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        if end["until"] <= start["until"]:
            return [Changes([])]
        return [Changes(p.folders, start["until"], end["until"]) for p in _plan(self.roots, self.splits, Pruning())]

    def read(self, partition: Changes) -> Iterator[pa.RecordBatch]:
        def changed(row: tuple) -> bool:
            return not row[3] and partition.start < max(row[5] or 0, row[6] or 0) <= partition.end

        return _batches(filter(changed, _read(partition.folders, Pruning())))

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""


class FolderSource(DataSource):
    """Options: ``path`` (as ``load`` gives it) or ``roots``, and ``splits`` (64)."""

    @classmethod
    def name(cls) -> str:
        return "media_folders"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[list[str], int]:
        roots = json.loads(self.options["roots"]) if "roots" in self.options else [self.options["path"]]
        return [*dict.fromkeys(r if r.endswith("://") else r.rstrip("/") or "/" for r in roots)], int(self.options.get("splits", 64))

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(*self._given())

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(*self._given())


def register(spark: SparkSession) -> None:
    """Makes the format known; Spark refuses a reader that takes filters unless it is told to push some."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
