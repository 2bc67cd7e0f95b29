"""Data source ``npz``: a dataset grid as compressed NumPy files of bounded size, and back."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from tidemark.sources.staged import Attempt, Filled, Staged, listed, opened

CELL = ("pct", "T", "mode", "seed", "split")
SCHEMA = "route_id string, X_seq array<array<float>>, X array<float>, y array<tinyint>, pct int, T int, mode string, seed int, split string"
NAME = re.compile(r"(?P<pct>\d+)/slice_(?P<T>\d+)_(?P<mode>\w+)/seed_(?P<seed>\d+)/(?P<split>[a-z]+)-\d+-\d+\.npz")


class Shards(DataSourceArrowWriter):
    """A task's rows come sorted by cell; a file is written when the cell changes or it holds ``limit`` rows."""

    def __init__(self, path: str, replace: bool, limit: int):
        self.target, self.limit = Staged(path, replace), limit

    def write(self, batches: Iterator[pa.RecordBatch]) -> Filled:
        mine, held, cell, files = Attempt(self.target.staging), [], None, 0
        task = TaskContext.get().partitionId()

        def save() -> None:
            nonlocal files
            if held:
                pct, T, mode, seed, split = cell
                mine.put(f"{pct}/slice_{T}_{mode}/seed_{seed}/{split}-{task:05d}-{files:05d}.npz", as_npz(pa.Table.from_batches(held), T))
                files += 1
                held.clear()

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in CELL]))
            at = 0
            while at < len(keys):
                if keys[at] != cell:
                    save()
                    cell = keys[at]
                room = self.limit - sum(b.num_rows for b in held)
                end = at
                while end < len(keys) and keys[end] == cell and end - at < room:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
                if sum(b.num_rows for b in held) == self.limit:
                    save()
        save()
        return mine.filled()

    def commit(self, messages: list) -> None:
        self.target.commit(messages)

    def abort(self, messages: list) -> None:
        self.target.abort()


def as_npz(rows: pa.Table, T: int) -> bytes:
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    X, y = flat("X").astype("float32").reshape(rows.num_rows, -1), flat("y").astype("int8").reshape(rows.num_rows, -1)
    out = io.BytesIO()
    np.savez_compressed(out, X=X, X_seq=X.reshape(rows.num_rows, T, -1), y=y, route_ids=np.array(rows.column("route_id").to_pylist(), dtype=str))
    return out.getvalue()


@dataclass
class ShardFiles(InputPartition):
    names: list[str]


class ReadShards(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.each = options["path"].rstrip("/"), int(options.get("filesPerTask", "16"))

    def partitions(self) -> list[ShardFiles]:
        names = [n for n in listed(self.root) if NAME.fullmatch(n)]
        return [ShardFiles(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [ShardFiles([])]

    def read(self, part: ShardFiles) -> Iterator[tuple]:
        store, root = opened(self.root)
        for name in part.names:
            of = NAME.fullmatch(name)
            cell = (int(of["pct"]), int(of["T"]), of["mode"], int(of["seed"]), of["split"])
            with store.open_input_stream(f"{root}/{name}") as f:
                held = np.load(io.BytesIO(f.read()))
            for i, x, flat, y in zip(held["route_ids"], held["X_seq"], held["X"], held["y"]):
                yield (str(i), x.tolist(), flat.tolist(), y.tolist(), *cell)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReadShards:
        return ReadShards(self.options)

    def writer(self, schema, overwrite: bool) -> Shards:
        return Shards(self.options["path"], overwrite, int(self.options.get("rowsPerFile", "50000")))


def write_npz(dataset: DataFrame, folder: str, rows_per_file: int = 50_000) -> None:
    """Files ``{pct}/slice_{T}_{mode}/seed_{seed}/{split}-{task}-{number}.npz`` of at most ``rows_per_file`` rows.

    Rows are dealt by ranges of cell and route, so a large cell is written by several tasks. A failed write leaves nothing.
    """
    dataset.sparkSession.dataSource.register(ArrayFiles)
    rows = dataset.select("route_id", "X", "y", *CELL).repartitionByRange(*CELL, "route_id").sortWithinPartitions(*CELL, "route_id")
    rows.write.format("npz").option("rowsPerFile", rows_per_file).mode("overwrite").save(folder)


def read_npz(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("npz").load(folder)
