"""A repository's head as a stream: a row whenever it moves."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are commits, so a restart goes on from the last one that was handled."""

    def __init__(self, repo: str, ref: str):
        self.repo, self.ref = repo, ref

    def _head(self) -> str:
        done = subprocess.run(["git", "-C", self.repo, "rev-parse", "--verify", "--quiet", self.ref], capture_output=True, text=True)
        return done.stdout.strip()

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        head = self._head()
        moved = head and head != start["sha"]
        return iter([(start["sha"], head, int(time.time()))] if moved else []), {"sha": head or start["sha"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["sha"], end["sha"], int(time.time()))] if start["sha"] != end["sha"] else [])


class RefSource(DataSource):
    """Options: path of the repository, ref (HEAD)."""

    @classmethod
    def name(cls) -> str:
        return "git_ref"

    def schema(self) -> str:
        return "old string, new string, seen_at long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("ref", "HEAD"))


def moves(spark: SparkSession, repo: str, ref: str = "HEAD") -> DataFrame:
    """(old, new, seen_at) as a stream; old is empty at first."""
    spark.dataSource.register(RefSource)
    return spark.readStream.format("git_ref").option("path", repo).option("ref", ref).load()


def watch(spark: SparkSession, repo: str, update: Callable[[str, str], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call ``update(old, new)`` for each move; polls ``every`` so long, or once with None. Moves that come together are one."""

    def batch(rows: DataFrame, _: int) -> None:
        found = rows.orderBy("seen_at").collect()  # one row a poll
        if found:
            update(found[0].old, found[-1].new)

    writer = moves(spark, repo).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
