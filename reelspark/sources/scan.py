"""Video files under a directory as a table: a frontier of directories, or a Python data source with a partition a sub-directory."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelspark.functions import fixed as X
from reelspark.plans.cut import cut

SCHEMA = "path string, size long"


def hidden(name: str) -> bool:
    return name.startswith(".") or name == "__pycache__"


class Below(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.deep = options["path"], str(options.get("recursive", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            return [Below("", False)]
        subs = [e.path for e in os.scandir(self.root) if self.deep and e.is_dir(follow_symlinks=False) and not hidden(e.name)]
        return [Below(self.root, False), *(Below(s, True) for s in sorted(subs))]

    def read(self, partition: Below) -> Iterator[tuple]:
        for top, dirs, files in os.walk(partition.path) if partition.path else ():
            dirs[:] = [d for d in dirs if not hidden(d)] if partition.deep else []
            for name in files:
                path = os.path.join(top, name)
                if os.path.splitext(name)[1][1:].lower() in X.VIDEO_EXTENSIONS and os.path.isfile(path):
                    yield path, os.path.getsize(path)


class VideoFiles(DataSource):
    """``spark.read.format("videofiles").load(directory)``; option ``recursive`` (true). A missing directory is empty."""

    @classmethod
    def name(cls) -> str:
        return "videofiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _listed(batches: Iterator[pd.DataFrame], deep: bool) -> Iterator[pd.DataFrame]:
    """Directories to look into, and names of video files, in each of the directories."""
    for b in batches:
        for top in b["path"]:
            rows = []
            try:
                with os.scandir(top) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            if deep and not hidden(e.name):
                                rows.append((e.path, True))
                        elif os.path.splitext(e.name)[1][1:].lower() in X.VIDEO_EXTENSIONS:
                            rows.append((e.path, False))
            except OSError:  # it has gone, or may not be read
                continue
            for a in range(0, len(rows), 65536):
                yield pd.DataFrame(rows[a : a + 65536], columns=["path", "folder"])


def _sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(p, os.path.getsize(p)) for p in b["path"] if os.path.isfile(p)]
        yield pd.DataFrame(rows, columns=["path", "size"])


def find_video_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """``path, size``, sorted by path in code-point order. All executors must see the directory; a missing one is empty.

    Directories are a frontier that is listed level by level, each level dealt anew over all tasks, and so are the files, whose sizes
    are asked for afterwards; so neither a deep tree nor a large directory keeps one task busy with all of it.
    """
    level = spark.createDataFrame([(directory,)] if os.path.isdir(directory) else [], "path string")
    files = spark.createDataFrame([], "path string")
    tasks = spark.sparkContext.defaultParallelism
    while not level.isEmpty():
        found = cut(level.repartition(tasks).mapInPandas(partial(_listed, deep=recursive), "path string, folder boolean"))
        files = files.unionByName(found.filter("not folder").select("path"))
        level = found.filter("folder").select("path")
    return files.repartition(tasks).mapInPandas(_sized, SCHEMA).orderBy("path")


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*X.VIDEO_EXTENSIONS)


def in_hidden_directory(path: Column) -> Column:
    """Is one of the directories of a path hidden? The file's own name doesn't count."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: d.startswith(".") | (d == "__pycache__"))
