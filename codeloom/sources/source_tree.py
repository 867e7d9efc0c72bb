"""A Spark data source that lists source trees, pruning excluded directories before it descends.

``spark.read.format("source_tree").option("excludeDirs", ...).load(root)`` gives path, name, suffix,
size_bytes, the times, is_dir and content; directories only with the option ``dirs``. Spark's own binary reader
drops names that begin with ``_`` or ``.``; this one keeps them. The driver lists directories down to ``SPREAD``
of them, and each is a partition of its own: those above with their own files only, the last with all below.
``pattern`` is matched from the right, against as many parts of the path as it has.
``root`` is a local or mounted path that every executor sees. A missing root is an error of the indexer, or an
empty listing with the option ``missing`` set to ``empty``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import PurePath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.operators.scanning import EXCLUDED_DIRS, EXCLUDED_EXTENSIONS, MAX_BYTES
from codeloom.runtime.errors import IndexerError

SCHEMA = "path string, name string, suffix string, size_bytes long, created timestamp, modified timestamp, accessed timestamp, is_dir boolean, content binary"
#: Directories that the driver looks for before it stops to descend.
SPREAD = 256


@dataclass
class Subtree(InputPartition):
    top: str
    descend: bool


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path")
        self.found = bool(self.root) and os.path.isdir(self.root)
        if not self.found and options.get("missing") != "empty":
            raise IndexerError(f"not a directory: {self.root}", project_path=self.root)
        self.dirs = _listed(options.get("excludedirs"), EXCLUDED_DIRS)
        self.extensions = _listed(options.get("excludeextensions"), EXCLUDED_EXTENSIONS)
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.pattern = options.get("pattern", "*")
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.content = str(options.get("content", "true")).lower() == "true"
        self.with_dirs = str(options.get("dirs", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        if not self.found:
            return []
        flat, wave = [self.root], self._below(self.root) if self.recursive else []
        while wave and len(flat) + len(wave) < SPREAD:
            flat, wave = flat + wave, [d for t in wave for d in self._below(t)]
        return [Subtree(t, False) for t in flat] + [Subtree(t, True) for t in wave]

    def _below(self, top: str) -> list[str]:
        try:
            return sorted(x.path for x in os.scandir(top) if x.is_dir(follow_symlinks=False) and x.name not in self.dirs)
        except OSError:
            return []

    def read(self, partition: Subtree | None) -> Iterator[tuple]:
        stack = [partition.top] if partition else []  # Spark asks once without a partition where there is none
        while stack:
            try:
                entries = sorted(os.scandir(stack.pop()), key=lambda x: x.name)
            except OSError:
                continue
            for x in entries:
                if x.is_dir(follow_symlinks=False):
                    if x.name in self.dirs:
                        continue
                    if partition.descend:
                        stack.append(x.path)
                    if self.with_dirs and PurePath(x.path).match(self.pattern):
                        yield x.path, x.name, os.path.splitext(x.name)[1], None, *_times(x.stat()), True, None
                elif (row := self._file(x)) is not None:
                    yield row

    def _file(self, x: os.DirEntry) -> tuple | None:
        suffix = os.path.splitext(x.name)[1]
        if suffix in self.extensions or not PurePath(x.path).match(self.pattern):
            return None
        try:
            st = x.stat()
            if st.st_size > self.most:
                return None
            data = None
            if self.content:
                with open(x.path, "rb") as f:
                    data = f.read()
        except OSError:
            return None
        return x.path, x.name, suffix, st.st_size, *_times(st), False, data


def _times(st: os.stat_result) -> tuple[datetime, ...]:
    """Created, modified and accessed."""
    return tuple(datetime.fromtimestamp(t, UTC) for t in (st.st_ctime, st.st_mtime, st.st_atime))


def _listed(value: str | None, default: tuple) -> frozenset[str]:
    return frozenset(x.strip() for x in value.split(",") if x.strip()) if value else frozenset(default)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
