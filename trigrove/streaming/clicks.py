"""Click feed: clicks to the log and to usage counters."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trigrove.model import Profile, UNIX
from trigrove.operators.index import LookupTables
from trigrove.operators.training import click_rows
from trigrove.operators.usage import access_counts, first_usage, merge_usage
from trigrove.plans.search import ranked_rows
from trigrove.sources.clicklog import click_lines
from trigrove.plans.shared import written
from trigrove.sources.snapshot import VersionConflict, VersionedTable
from trigrove.streaming.changes import ATTEMPTS, feed_name

FEED = "clicks"


@dataclass
class ClickStores:
    """Where clicks go: usage versions, the log and the rejected rows."""

    usage: VersionedTable
    log: str
    rejects: str


def record_batch(
    clicks: DataFrame,
    batch_id: int,
    tables: LookupTables,
    stores: ClickStores,
    *,
    model=None,
    profile: Profile = UNIX,
    now: Callable[[], int] = lambda: int(time.time()),
    feed: str = FEED,
) -> bool:
    """Log a batch of clicks with all that was shown for each, and count them.

    Clicks have ``query_id, query, selected_id, timestamp, rank_position`` and may have the context
    columns. One on an entry that is not in the catalog goes to the rejects. Log and rejects are
    written to a folder of the feed and batch, so a repeated batch overwrites its own rows only. If another writer publishes counters
    meanwhile, the batch is counted again on top of what it left.
    """
    if stores.usage.applied(feed, batch_id):
        return False
    clicks = written(clicks, "clicks")  # worked out once for all that follows
    if clicks.isEmpty():
        return False
    usage = stores.usage.read()
    keyed = clicks.withColumn("entry_id", F.col("selected_id").try_cast("long"))
    entries = tables.catalog.select(F.col("id").alias("entry_id"), F.col("name").alias("selected_name"))
    known = keyed.join(entries, "entry_id")
    unknown = keyed.join(entries, "entry_id", "left_anti").drop("entry_id")
    at = now()
    ranked = ranked_rows(known, tables, usage, now=at, model=model, profile=profile)
    shown = click_rows(ranked, known)
    context = F.struct(
        *[
            (F.col(c) if c in clicks.columns else F.lit(None).cast(kind)).alias(c)
            for c, kind in (("active_app", "string"), ("cwd", "string"), ("timestamp", "long"),
                            ("hour_of_day", "int"), ("day_of_week", "int"))
        ]
    )
    click_lines(shown.withColumn("context", context)).write.mode("overwrite").text(f"{stores.log}/feed={feed}/batch_id={batch_id}")
    unknown.write.mode("overwrite").json(f"{stores.rejects}/feed={feed}/batch_id={batch_id}")
    counted = access_counts(known.select("entry_id", F.col("timestamp").alias("ts"), F.col("timestamp").alias("seq")))
    for attempt in range(ATTEMPTS):
        number = stores.usage.number()
        usage = stores.usage.read()
        start = first_usage(tables.catalog, usage, counted)
        merged = merge_usage(usage.select("entry_id", "access_count", "last_accessed").unionByName(start), counted)
        try:
            stores.usage.publish(merged, at, feed, batch_id, after=number)
            return True
        except VersionConflict:
            if attempt + 1 == ATTEMPTS:
                raise
    return False


def stream_clicks(
    clicks: DataFrame, tables: LookupTables, stores: ClickStores, checkpoint: str, *,
    available_now: bool = False, interval: str = "500 milliseconds", **batch_options,
) -> StreamingQuery:
    def one(batch: DataFrame, batch_id: int) -> None:
        record_batch(batch, batch_id, tables, stores, feed=feed_name(FEED, batch), **batch_options)

    writer = clicks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
