"""Source trees as a Spark data source that reads every name, those that start with a dot or underscore too.

Spark's own file readers skip such names. Here the driver lists the upper folders only; each of them is a
partition that a task walks and reads by itself, a file at a time. Roots are addresses that Arrow's file systems
open on every executor: a mounted folder, ``s3://``, ``gs://`` or ``hdfs://``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from riskloom.sources.captures import SKIPPED_DIRS

SCHEMA = "repo string, path string, size bigint, content string"


@dataclass
class _Folder(InputPartition):
    path: str
    #: Whether the folders below belong to this partition.
    whole: bool

    def __post_init__(self) -> None:
        super().__init__((self.path, self.whole))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, repo_depth: int, split_depth: int, max_bytes: int | None):
        self.root, self.repo_depth, self.split_depth, self.max_bytes = root, repo_depth, split_depth, max_bytes

    def _store(self) -> tuple[fs.FileSystem, str]:
        address = self.root if ":/" in self.root else "file://" + self.root
        if address.startswith("file:/") and not address.startswith("file://"):
            address = "file://" + address.removeprefix("file:")
        store, path = fs.FileSystem.from_uri(address)
        return store, path.rstrip("/")

    @staticmethod
    def _entries(store: fs.FileSystem, path: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders that are not skipped, and files, by name."""
        found = sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name)
        folders = [i.path for i in found if i.type == fs.FileType.Directory and i.base_name not in SKIPPED_DIRS]
        return folders, [i for i in found if i.type == fs.FileType.File]

    def partitions(self) -> list[_Folder]:
        """Folders above ``repo_depth + split_depth`` with their own files, and those there as a whole."""
        store, root = self._store()
        out, level = [], [root]
        for _ in range(self.repo_depth + self.split_depth):
            out += [_Folder(path, False) for path in level]
            level = [folder for path in level for folder in self._entries(store, path)[0]]
        return out + [_Folder(path, True) for path in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        store, root = self._store()
        todo = [partition.path]
        while todo:
            folders, files = self._entries(store, todo.pop())
            if partition.whole:
                todo += reversed(folders)
            for info in files:
                if self.max_bytes is not None and info.size > self.max_bytes:
                    continue
                *folders, name = info.path[len(root) + 1 :].split("/")
                with store.open_input_stream(info.path) as stream:
                    data = stream.read()
                # Bytes that are no UTF-8 become replacement characters, as when read as text.
                content = data.decode("utf-8", "replace")
                repo, inside = folders[: self.repo_depth], folders[self.repo_depth :]
                yield "/".join(repo), "/".join([*inside, name]), len(data), content


class SourceTree(DataSource):
    """Options: ``path``, ``repo_depth`` (folders that name the repository), ``split_depth`` (levels of folders
    inside a repository that become partitions of their own), ``max_bytes`` (larger files are left out)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        most = self.options.get("max_bytes")
        return TreeReader(
            self.options["path"],
            int(self.options.get("repo_depth", 1)),
            int(self.options.get("split_depth", 1)),
            None if most is None else int(most),
        )


def read_whole_tree(
    spark: SparkSession, root: str, repo_depth: int = 1, max_bytes: int | None = None, split_depth: int = 1
) -> DataFrame:
    """``(repo, path, size, content)`` of every file below ``root``, whatever its name.

    The first ``repo_depth`` folders below the root name the repository; files above belong to none. Skipped
    folders are not entered, and files over the size limit, if one is given, are not opened.
    """
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("repo_depth", repo_depth).option("split_depth", split_depth)
    if max_bytes is not None:
        reader = reader.option("max_bytes", max_bytes)
    return reader.load(root)
