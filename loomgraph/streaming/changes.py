"""File changes as a stream: debounced, skipped where nothing changed, and written so that replays do no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import latest, upsert

#: Saves of a file that come this close count once.
DEBOUNCE = "400 milliseconds"


def debounce(changes: DataFrame, at: str = "ts", key: str = "path", within: str = DEBOUNCE) -> DataFrame:
    """One row for each ``key`` within so long, on a stream of changes."""
    return changes.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def apply_changes(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch's last row of each key into a table.

    The batch's rows replace those of their keys, so a batch that is replayed after a failure leaves the same table.
    """

    def batch(rows: DataFrame, _: int) -> None:
        write(upsert(read(), latest(rows, F.col(order), key), key))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit_counts(changes: DataFrame) -> DataFrame:
    """Running number of changes of each file, for an update-mode sink."""
    return changes.groupBy("path").agg(F.count(F.lit(1)).alias("commit_count"))


def churn_windows(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts by window and kind; rows later than ``late`` behind the newest are left out of closed windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
