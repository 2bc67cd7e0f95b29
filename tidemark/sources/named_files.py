"""Data source ``named_files``: rows (name, content) to a file each, with the name as it is, and whole files back to rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from tidemark.sources.staged import Attempt, Filled, Staged, listed, opened


@dataclass
class Files(InputPartition):
    names: list[str]


class WholeFiles(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern, self.each = options["path"].rstrip("/"), options.get("pattern", "*"), int(options.get("filesPerTask", "1000"))

    def partitions(self) -> list[Files]:
        names = [n for n in listed(self.root) if fnmatch(n.rpartition("/")[2], self.pattern)]
        return [Files(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Files([])]

    def read(self, part: Files) -> Iterator[tuple[str, str]]:
        store, root = opened(self.root)
        for name in part.names:
            with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                yield name, f.read().decode("utf-8", errors="replace")


class OneFileEach(DataSourceWriter):
    def __init__(self, path: str, replace: bool):
        self.target = Staged(path, replace)

    def write(self, rows: Iterator) -> Filled:
        mine = Attempt(self.target.staging)
        for row in rows:
            mine.put(row["name"], row["content"].encode())
        return mine.filled()

    def commit(self, messages: list) -> None:
        self.target.commit(messages)

    def abort(self, messages: list) -> None:
        self.target.abort()


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def reader(self, schema) -> WholeFiles:
        return WholeFiles(self.options)

    def writer(self, schema, overwrite: bool) -> OneFileEach:
        return OneFileEach(self.options["path"], overwrite)


def read_named(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, content) of the files below ``folder`` whose last part fits ``pattern``; the name is relative to the folder."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("pattern", pattern).load(folder)


def write_named(rows: DataFrame, folder: str, replace: bool = True) -> None:
    """A file for each row of (name, content); with ``replace`` what the folder held goes."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("overwrite" if replace else "append").save(folder)
