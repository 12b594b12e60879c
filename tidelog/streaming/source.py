"""A Structured Streaming source. Offsets are commit versions; a batch is planned from the names of folders alone,
and its commits are read by the executors with Arrow, in groups, so many small commits don't make many tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..model import LOG

_COMMIT, _RANGE = re.compile(r"commit_version=(\d+)$"), re.compile(r"range=(\d+)-(\d+)$")
_NAMES = ["commit_version", "batch_index", "type_name", "tags", "data"]


class Commits(InputPartition):
    def __init__(self, versions: tuple[int, ...], ranges: tuple[str, ...], low: int, high: int) -> None:
        self.versions, self.ranges, self.low, self.high = versions, ranges, low, high


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.base, self.group = options["path"].removeprefix("file://"), int(options.get("commitsPerTask", 64))
        if "://" in self.base:
            raise ValueError(f"the streaming source reads mounted folders, not {self.base}; use tail() of a Store")
        self.start = int(options.get("startingVersion", 0))

    def _listed(self) -> tuple[list[int], list[tuple[int, int]]]:
        names = os.listdir(self.base) if os.path.isdir(self.base) else []
        if "commit_version=1" in names and not any(n.startswith("range=1-") for n in names) and os.path.exists(f"{self.base}/commit_version=1/_load"):
            names = []  # a load whose range isn't in its place yet
        return sorted(int(m[1]) for n in names if (m := _COMMIT.match(n))), sorted((int(m[1]), int(m[2])) for n in names if (m := _RANGE.match(n)))

    def initialOffset(self) -> dict:
        return {"version": self.start}

    def latestOffset(self) -> dict:
        commits, ranges = self._listed()
        return {"version": max([self.start, *commits, *(b for _, b in ranges)])}

    def partitions(self, start: dict, end: dict) -> list[Commits]:
        low, high = start["version"], end["version"]
        commits, ranges = self._listed()
        wide: list[tuple[int, int]] = []
        for a, b in sorted(ranges, key=lambda r: (r[0], -r[1])):
            if b > low and a <= high and (not wide or b > wide[-1][1]):
                wide.append((a, b))
        single = [v for v in commits if low < v <= high and not any(a <= v <= b for a, b in wide)]
        out = [Commits(tuple(single[k : k + self.group]), (), low, high) for k in range(0, len(single), self.group)]
        for a, b in wide:
            folder = f"{self.base}/range={a}-{b}"
            out += [Commits((), (f"{folder}/{f}",), low, high) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]
        return out

    def read(self, partition: Commits) -> Iterator[pa.RecordBatch]:
        for v in partition.versions:
            folder = f"{self.base}/commit_version={v}"
            for f in sorted(os.listdir(folder)):
                if f.endswith(".parquet"):
                    t = pq.ParquetFile(f"{folder}/{f}").read()
                    yield from t.add_column(0, "commit_version", pa.array([v] * len(t), pa.int64())).select(_NAMES).to_batches()
        for f in partition.ranges:
            for batch in pq.ParquetFile(f).iter_batches():
                t = pa.Table.from_batches([batch]).select(_NAMES)
                v = t["commit_version"].to_numpy()
                yield from t.filter(pa.array((v > partition.low) & (v <= partition.high))).to_batches()

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Format ``tidelog``: ``path`` is the folder of a namespace, on storage that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self):
        return LOG

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def stream(spark: SparkSession, base: str, starting_version: int = 0) -> DataFrame:
    """A streaming log frame of a namespace's folder, from the version after ``starting_version``."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("tidelog").option("startingVersion", starting_version).load(base)
