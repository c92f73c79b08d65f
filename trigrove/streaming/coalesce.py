"""Coalescing over time: of the changes of a path only the latest leaves, once a waiting time has passed.

The batch form (:func:`trigrove.operators.catalog.coalesce_changes`) sees one micro-batch. Here a path that keeps changing
costs one change for each waiting time however many micro-batches its changes come in: the latest is kept in state, keyed by
the path, and a processing-time timer that starts with the first change sends it on. State is one row for each path that waits.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trigrove.model import Profile, UNIX
from trigrove.operators.catalog import path_key

CHANGE = "seq long, kind string, path string, is_dir boolean, size long, source string"
NAMES = [field.split()[0] for field in CHANGE.split(", ")]

#: Timers are kept by this state store only (fixed value of Spark).
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestChange(StatefulProcessor):
    """Holds the change of the highest ``seq`` of one path until its timer fires."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", CHANGE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.latest.get()) if self.latest.exists() else None
        best = held
        for row in rows:
            change = tuple(row[n] for n in NAMES)
            if best is None or change[0] > best[0]:
                best = change
        if held is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        if best is not held:
            self.latest.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.latest.get()
        self.latest.clear()
        yield Row(**dict(zip(NAMES, held, strict=True)))

    def close(self) -> None:
        pass


def coalesced(changes: DataFrame, wait_ms: int | None = None, profile: Profile = UNIX) -> DataFrame:
    """A stream of changes ``(seq, kind, path, is_dir, size, source)`` with the latest of each path per waiting time (the
    dialect's batch interval unless given).

    A change without ``seq`` or path fails. Changes that ask for a rescan or a rebuild are keyed by their path like others, so
    one of them is left too. Sets the session's state store to the one that has timers. The stream that starts from this must run
    with a processing-time trigger: one that stops with the input leaves what still waits in its checkpoint.
    """
    spark = changes.sparkSession
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    lost = F.raise_error(F.lit("a change needs a seq and a path"))
    key = F.when(F.col("seq").isNull() | F.col("path").isNull(), lost.cast("string")).otherwise(path_key("path", profile))
    source = F.col("source") if "source" in changes.columns else F.lit("files")
    # A change of another source than the files is of another thing, even if it names the same path.
    keyed = changes.select(
        F.concat_ws("\x00", F.coalesce(source, F.lit("files")), F.when(F.col("kind") == "Overflow", "!"), key).alias("key"),
        "seq", "kind", "path", "is_dir", F.col("size").cast("long").alias("size"), source.cast("string").alias("source"),
    )
    wait = profile.batch_interval_ms if wait_ms is None else wait_ms
    return keyed.groupBy("key").transformWithState(
        statefulProcessor=LatestChange(wait), outputStructType=CHANGE, outputMode="Append", timeMode="ProcessingTime"
    )


def drain(query: StreamingQuery, timeout_s: float = 120.0) -> None:
    """Stop a query over :func:`coalesced` once its input is used up and nothing waits any more; ``TimeoutError`` if that does not come."""
    until, read = time.monotonic() + timeout_s, 0
    while time.monotonic() < until and query.isActive:
        done = query.recentProgress
        read = max(read, sum(p["numInputRows"] for p in done))
        if read and not done[-1]["numInputRows"] and not any(s["numRowsTotal"] for s in done[-1]["stateOperators"]):
            query.stop()
            return
        time.sleep(0.1)
    failed = query.exception()
    query.stop()
    raise failed or TimeoutError("changes still wait")
