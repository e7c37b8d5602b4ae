"""A folder's files as a Spark data source that prunes while it lists.

The driver lists only the top of the tree, until there are folders enough to deal out; each task then walks
its own. A folder that is left out, by its name, is never opened, however much is in it, and links to folders
aren't followed. For folders that the driver and executors see under one path.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, rel string, name string, length long, modified double, folder boolean"
#: Folders that the driver looks for before it deals them out.
DEAL = 64


class Part(InputPartition):
    """Folders to walk, and folders whose own files the driver has listed already: those go along as rows."""

    def __init__(self, folders: list[str], rows: list[tuple]) -> None:
        self.folders, self.rows = folders, rows


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.skip_folders = frozenset(json.loads(options.get("skipfolders", "[]")))
        self.skip_files = json.loads(options.get("skipfiles", "[]"))
        self.deal = int(options.get("deal", DEAL))

    def _list(self, folder: str) -> tuple[list[tuple], list[str]]:
        """Rows of a folder's files, and its folders; what can't be listed has neither."""
        rows, inner = [self._row(folder, True)], []
        try:
            with os.scandir(folder) as entries:
                for e in sorted(entries, key=lambda x: x.name):
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in self.skip_folders:
                            inner.append(e.path)
                    elif e.is_file(follow_symlinks=True) and not any(fnmatch.fnmatch(e.name, p) for p in self.skip_files):
                        rows.append(self._row(e.path, False))
        except PermissionError:
            pass
        return rows, inner

    def _row(self, path: str, folder: bool) -> tuple:
        found = os.stat(path)
        rel = os.path.relpath(path, self.root)
        return path, "" if rel == "." else rel, os.path.basename(path), 0 if folder else found.st_size, found.st_mtime, folder

    def partitions(self) -> list[Part]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        rows: list[tuple] = []
        open_ = [self.root]
        while open_ and len(open_) < self.deal:
            level, open_ = open_, []
            for folder in level:
                found, inner = self._list(folder)
                rows += found
                open_ += inner
        return [Part([], rows), *(Part([f], []) for f in open_)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.rows
        folders = list(partition.folders)
        while folders:
            rows, inner = self._list(folders.pop())
            yield from rows
            folders += inner


class FolderSource(DataSource):
    """spark.read.format("folder").load(path): options skipFolders and skipFiles (JSON lists of names and patterns), deal."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:  # noqa: ARG002
        return FolderReader(self.options)


def listing(spark: SparkSession, folder: str, skip_folders: list[str], skip_files: list[str], deal: int = DEAL) -> DataFrame:
    """path, rel, name, length, modified, folder of everything below a folder that isn't left out; folder: whether it is one, the root included."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("skipFolders", json.dumps(skip_folders)).option("skipFiles", json.dumps(skip_files)).option("deal", deal).load(folder)


def contents(spark: SparkSession, files: DataFrame, most: int) -> DataFrame:
    """rel, name, content of listed files of at most so many bytes, read where they are asked for."""
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):  # a file at a time: each may be as long as `most`
                row = batch.slice(i, 1)
                try:
                    with open(row.column(0)[0].as_py(), "rb") as file:
                        raw = file.read()
                except OSError:
                    raw = None
                yield pa.RecordBatch.from_arrays([row.column(1), row.column(2), pa.array([raw], pa.binary())], names=["rel", "name", "content"])

    return files.where(~F.col("folder") & (F.col("length") <= most)).select("path", "rel", "name").mapInArrow(run, "rel string, name string, content binary")


#: Readers of named sources, by the kind that a configuration gives.
ADAPTERS: dict = {}


def adapter(kind: str):
    """Registers a reader (spark, target, config) -> DataFrame for sources of that kind."""

    def add(f):
        ADAPTERS[kind] = f
        return f

    return add


def configured(spark: SparkSession, target: str, config: dict[str, dict]):
    """A catalog of the sources that a configuration names: {source: {kind, ...}}; an unknown kind or a reader that fails is an error of that source alone."""
    from attestra.plans.catalog import Catalog

    out = Catalog(spark)
    for name, given in config.items():

        def read(given: dict = given) -> DataFrame:
            if given.get("kind") not in ADAPTERS:
                raise ValueError(f"no adapter is called {given.get('kind')}")
            return ADAPTERS[given["kind"]](spark, target, given)

        out.load(name, read)
    return out


def _place(target: str, config: dict, default: str = "") -> str:
    return os.path.join(target, str(config.get("path", default)))


def _register() -> None:
    from attestra.sources import commits, readers

    adapter("table")(lambda s, t, c: readers.yaml_records(s, _place(t, c), c.get("key")) if str(c.get("path", "")).endswith((".yml", ".yaml")) and os.path.exists(_place(t, c)) else readers.records(s, _place(t, c)))
    adapter("lock_file")(lambda s, t, c: readers.lock_file(s, _place(t, c, "requirements.txt")))
    adapter("git_log")(lambda s, t, c: commits.git_log(s, _place(t, c, "git_log.txt"), c.get("governed_paths"), c.get("prefix", "")))
    adapter("commit_range")(lambda s, t, c: commits.commit_range(commits.git_log(s, _place(t, c, "git_log.txt")), c.get("since"), c.get("until"), c.get("first", []), c.get("second", [])))
    adapter("environment")(lambda s, t, c: readers.signals(listing(s, t, readers.SKIPPED_FOLDERS, readers.SKIPPED_FILES).where("NOT folder")))
    adapter("documents")(lambda s, t, c: readers.documents(s, _place(t, c)))


_register()
