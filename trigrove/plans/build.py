"""Start-up: the first catalog version, from storage or from a scan."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.model import MAX_ENTRIES, Profile, UNIX
from trigrove.operators.catalog import as_catalog, merge_last, replace_catalog
from trigrove.sources.snapshot import SnapshotError, VersionConflict, VersionedTable, check_limits

ATTEMPTS = 5


def _stored(store: VersionedTable) -> DataFrame | None:
    """The stored catalog, read through once; None if there is none or it is damaged."""
    try:
        rows = store.read()
        seen = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns))).first()
    except (SnapshotError, OSError, PySparkException, Py4JJavaError):
        return None
    return rows if seen["n"] else None


def build_catalog(
    store: VersionedTable,
    scan_files: Callable[[], DataFrame],
    catalog_rows: DataFrame,
    *,
    now: int,
    mode: str = "auto",
    profile: Profile = UNIX,
) -> DataFrame:
    """Publish a catalog and return it.

    ``auto`` starts from the stored catalog and scans files only when there is none or it cannot be
    read; ``full`` always scans. Applications and settings come from ``catalog_rows`` every time.
    In the dialect with limits a stored catalog beyond them is an error that names entries.
    """
    for attempt in range(ATTEMPTS):
        stored = _stored(store)
        try:
            number = store.number()
        except (SnapshotError, PySparkException):
            number = None  # what is there is no store: the new version is its first
        if stored is not None and profile.stored_limits:
            check_limits(stored, MAX_ENTRIES)
        base = store.spark.createDataFrame([], store.schema) if stored is None else as_catalog(stored)
        if mode == "full" or stored is None:
            base = merge_last(base, scan_files())
        try:
            store.publish(replace_catalog(base, catalog_rows, profile), now, "build", after=number)
        except VersionConflict:
            if attempt + 1 == ATTEMPTS:
                raise
            continue
        return store.read()
