"""A streaming data source of files that are written again under their old names."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .reports import REPORT

#: Files that a task reads.
FILES_A_TASK = 100


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class FileChanges(DataSourceStreamReader):
    """Files below a folder in order of (time last written, path), which is the offset.

    A file that is written again takes a new place in that order, and is read again. Files written within the last `settle`
    seconds wait, so that none comes to stand before an offset that has been handed out.
    """

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".json")
        self.settle = float(options.get("settle", 2))
        self.start = self.last = (int(float(options.get("start", 0)) * 1e9), "")

    def _files(self, after: tuple[int, str]) -> list[tuple[int, str]]:
        before = time.time_ns() - int(self.settle * 1e9)
        found = []
        folders = [self.path]
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.is_dir():
                        folders.append(e.path)
                    elif e.name.endswith(self.suffix) and not e.name.startswith((".", "_")):
                        at = (e.stat().st_mtime_ns, e.path)
                        if after < at and at[0] < before:
                            found.append(at)
        return sorted(found)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ns": self.start[0], "path": self.start[1]}

    def latestOffset(self) -> dict:  # noqa: N802
        self.last = max([self.last, *self._files(self.last)[-1:]])
        return {"ns": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        upto = (end["ns"], end["path"])
        files = [f for f in self._files((start["ns"], start["path"])) if f <= upto]
        return [Files(files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for ns, path in partition.files:
            with open(path, encoding="utf-8", errors="replace") as file:
                yield path, ns // 1_000_000, file.read()

    def commit(self, end: dict) -> None:
        pass


class FileChangeSource(DataSource):
    """path, changed_ms, value (a file's whole text). Options: path, suffix, settle (seconds), start (seconds since 1970)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, changed_ms bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802, ANN001
        return FileChanges(dict(self.options))


def stream_changed_reports(spark: SparkSession, path: str, start: float = 0, settle: float = 2) -> DataFrame:
    """run_id, changed_at and the fields of reports of a folder as a stream: new ones, and those written again.

    The checkpoint holds the last file's time and path, so that a query that is started again repeats none and misses
    none. Files last written at start (seconds since 1970) or before are passed over; files that aren't reports are
    dropped. The folder is listed by the driver and read by the executors, which must all have it mounted; for a store
    that only Spark reads, see streaming.live.watch_reports.
    """
    spark.dataSource.register(FileChangeSource)
    raw = spark.readStream.format("file_changes").option("path", path).option("settle", settle).option("start", start).load()
    parsed = raw.select(F.col("path").alias("run_id"), F.timestamp_millis("changed_ms").alias("changed_at"), F.from_json("value", REPORT).alias("r"))
    return parsed.where("r.runs IS NOT NULL").select("run_id", "changed_at", "r.*")
