"""Change feed: watcher events to catalog versions, in micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from trigrove.functions import paths
from trigrove.model import Profile, UNIX, UNIX_EXCLUDES
from trigrove.operators.catalog import apply_changes, carry_usage, replace_catalog, replace_files
from trigrove.plans.pathed import PathedCatalog
from trigrove.plans.shared import written
from trigrove.sources.snapshot import VersionConflict, VersionedTable

FEED = "changes"
SHORTEST_MS, LONGEST_MS = 50, 5000
ATTEMPTS = 5


def translate_events(
    events: DataFrame, roots: list[str] | None = None, excludes=UNIX_EXCLUDES, profile: Profile = UNIX
) -> DataFrame:
    """Changes ``(seq, kind, path, is_dir, size, source)`` from watcher events.

    Events have ``seq, kind, path, new_path, is_dir, size, source`` with the kinds create, remove,
    modify and rename; others are dropped. A rename with both paths is a removal and a creation.
    Only paths the feed's exclusion rule keeps pass. Works on batch and streaming tables.
    """
    def change(kind: str, path: str, step: int):
        return F.struct(
            (F.col("seq") * 2 + step).alias("seq"), F.lit(kind).alias("kind"), F.col(path).alias("path"),
            "is_dir", "size", "source",
        )

    both = F.col("new_path").isNotNull()
    made = (
        F.when(F.col("kind") == "create", F.array(change("Created", "path", 0)))
        .when(F.col("kind") == "remove", F.array(change("Removed", "path", 0)))
        .when((F.col("kind") == "rename") & both, F.array(change("Removed", "path", 0), change("Created", "new_path", 1)))
        .when(F.col("kind").isin("modify", "rename"), F.array(change("Modified", "path", 0)))
        .when(F.col("kind") == "overflow", F.array(change("Overflow", "path", 0)))
    )
    changes = events.select(F.explode(made).alias("c")).select("c.*")
    kept = paths.event_keeps(F.col("path"), roots, excludes, profile.name == "windows") if roots else F.lit(True)
    return changes.where((F.coalesce("source", F.lit("files")) != "files") | (F.col("kind") == "Overflow") | kept)


def feed_name(kind: str, batch: DataFrame) -> str:
    """The name of the stream that a micro-batch belongs to, the same after every restart from its checkpoint."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return kind if run is None else f"{kind}-{run}"


def apply_batch(
    store: VersionedTable,
    changes: DataFrame,
    batch_id: int,
    *,
    listing: DataFrame | None = None,
    desktop_files: DataFrame | None = None,
    rebuild: Callable[[], DataFrame] | None = None,
    rescan: Callable[[], DataFrame] | None = None,
    profile: Profile = UNIX,
    now: Callable[[], int] = lambda: int(time.time()),
    feed: str = FEED,
) -> bool:
    """One catalog version from one batch; a batch already applied, or empty, changes nothing.

    Batches are numbered within ``feed``: feeds that number their own batches need names of their own.

    An overflow row means events were lost: all files are read again with ``rescan``. Any row of the
    source ``catalog`` makes ``rebuild`` deliver the applications and settings anew, once. Without the function
    that a row asks for the batch fails, and no version is published as if nothing were lost. If another
    writer publishes meanwhile, the batch is applied again to what it left.
    """
    if store.applied(feed, batch_id):
        return False
    changes = written(changes, "changes")  # worked out once for all that follows
    seen = changes.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("kind") == "Overflow").alias("overflow"),
        F.count_if(F.col("source") == "catalog").alias("dirty"),
    ).first()
    if not seen["rows"]:
        return False
    if seen["overflow"] and rescan is None:
        raise ValueError("events were lost: rescan is needed to read the files again")
    if seen["dirty"] and rebuild is None:
        raise ValueError("applications or settings have changed: rebuild is needed to read them again")
    files = changes.where("coalesce(source, 'files') = 'files' and kind <> 'Overflow'")
    for attempt in range(ATTEMPTS):
        number = store.number()
        catalog = store.read()
        if seen["overflow"]:
            catalog = replace_files(catalog, rescan(), profile)
        else:
            catalog = apply_changes(catalog, files, listing=listing, desktop_files=desktop_files, profile=profile)
        if seen["dirty"]:
            catalog = replace_catalog(catalog, rebuild(), profile)
        try:
            store.publish(catalog, now(), feed, batch_id, after=number)
        except VersionConflict:
            if attempt + 1 == ATTEMPTS:
                raise
            continue
        return True
    return False


def stream_changes(
    changes: DataFrame, store: VersionedTable, checkpoint: str, *, available_now: bool = False,
    interval_ms: int | None = None, profile: Profile = UNIX, **batch_options,
) -> StreamingQuery:
    """Apply a stream of changes as it arrives.

    The catalog and not the stream holds all state; with the batch id kept beside each version,
    a batch that is run again after a failure is recognised. Batches are numbered from 0 in every new checkpoint folder, so
    the feed goes by the id of the streaming query, which that folder keeps.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch, batch_id, profile=profile, feed=feed_name(FEED, batch), **batch_options)

    return _started(changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint), available_now, interval_ms, profile)


def stream_changes_by_path(
    changes: DataFrame, store: PathedCatalog, checkpoint: str, *, available_now: bool = False, interval_ms: int | None = None,
    listing: DataFrame | None = None, desktop_files: DataFrame | None = None,
) -> StreamingQuery:
    """Apply a stream of changes to a catalog in the order of its paths: each batch reads and writes only where its paths lie.

    Such a catalog is made anew with ``build`` after lost events or changes of applications and settings; a batch that asks for either fails."""

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch, "changes")  # worked out once for all that follows
        if not rows.where("kind = 'Overflow' or source = 'catalog'").isEmpty():
            raise ValueError("events were lost or applications have changed: the catalog has to be built again")
        if not rows.isEmpty():
            store.apply(rows, listing=listing, desktop_files=desktop_files, feed=feed_name(FEED, batch), feed_batch=batch_id)

    return _started(changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint), available_now, interval_ms, store.profile)


def _started(writer: DataStreamWriter, available_now: bool, interval_ms: int | None, profile: Profile) -> StreamingQuery:
    if available_now:
        return writer.trigger(availableNow=True).start()
    wait = profile.batch_interval_ms if interval_ms is None else interval_ms
    if profile.name == "windows":
        wait = min(max(wait, SHORTEST_MS), LONGEST_MS)
    return writer.trigger(processingTime=f"{wait} milliseconds").start()
