"""Usage counters: how often and when last an entry was picked, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.functions import paths

DAY = 86_400
DECAY = 0.8


def _capped(count: Column, cap: int | None) -> Column:
    return count if cap is None else F.least(count, F.lit(cap))


def access_counts(accesses: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per picked entry from rows ``(entry_id, ts, seq)``: number of picks and time of the last one.

    Partial aggregation runs before the shuffle, so a much-picked entry costs one row per task. ``cap``: the
    largest count of a store that has one.
    """
    return accesses.groupBy("entry_id").agg(
        _capped(F.count("*"), cap).alias("access_count"),
        F.max_by("ts", F.coalesce("seq", "ts")).alias("last_accessed"),
    )


def first_usage(entries: DataFrame, usage: DataFrame, picked: DataFrame) -> DataFrame:
    """Usage rows of ``picked`` entries that have none yet, with the counters that the entries came with."""
    own = entries.select(F.col("id").alias("entry_id"), F.coalesce("access_count", F.lit(0)).alias("access_count"), F.coalesce("last_accessed", F.lit(0)).alias("last_accessed"))
    return own.join(picked.select("entry_id"), "entry_id", "left_semi").join(usage.select("entry_id"), "entry_id", "left_anti").where("access_count > 0")


def merge_usage(old: DataFrame, new: DataFrame, cap: int | None = None) -> DataFrame:
    """Add newly counted picks to known counters; the later batch sets the time."""
    rows = old.select("entry_id", "access_count", "last_accessed", F.lit(0).alias("batch")).unionByName(
        new.select("entry_id", "access_count", "last_accessed", F.lit(1).alias("batch"))
    )
    return rows.groupBy("entry_id").agg(
        _capped(F.sum("access_count"), cap).alias("access_count"),
        F.max_by("last_accessed", "batch").alias("last_accessed"),
    )


def with_usage(rows: DataFrame, usage: DataFrame | None) -> DataFrame:
    """Counters of each row's ``id``: the usage row where there is one, else the row's own counters."""
    if usage is None:
        return rows
    used = usage.select(
        F.col("entry_id").alias("id"),
        F.col("access_count").alias("used_count"),
        F.col("last_accessed").alias("used_last"),
    )
    joined = rows.join(used, "id", "left")
    return joined.withColumns(
        {
            "access_count": F.coalesce("used_count", "access_count"),
            "last_accessed": F.coalesce("used_last", "last_accessed"),
            "frecency_score": F.coalesce(F.col("used_count").cast("double"), "frecency_score"),
        }
    ).drop("used_count", "used_last")


def daily_frecency(now: int, zero_count_uses_score: bool = False) -> Column:
    """Picks, losing a fifth of their weight per whole day since the last one."""
    count = F.coalesce(F.col("access_count"), F.lit(0))
    last = F.coalesce(F.col("last_accessed"), F.lit(0))
    days = F.floor(F.greatest(F.lit(int(now)) - last, F.lit(0)) / DAY)
    unused = F.greatest(F.coalesce(F.col("frecency_score"), F.lit(0.0)), F.lit(0.0)) if zero_count_uses_score else F.lit(0.0)
    return F.when(count > 0, count * F.pow(F.lit(DECAY), days)).otherwise(unused)


def _shares(counted: DataFrame, key: str) -> DataFrame:
    totals = counted.groupBy(key).agg(F.sum("access_count").alias("opens"))
    everything = counted.agg(F.sum("access_count").alias("opens"))
    return (
        totals.where(F.col(key).isNotNull() & (F.col("opens") > 0))
        .select(key, (F.col("opens") / everything.scalar()).alias("share"))
    )


def file_type_popularity(catalog: DataFrame, usage: DataFrame | None = None, windows: bool = False) -> DataFrame:
    """Share of each file type in all picks of files: ``(file_type, share)``, empty without picks."""
    files = catalog.where("entry_type = 'File'").select(
        "id",
        paths.entry_file_type(F.col("metadata.file_type"), F.col("path"), windows).alias("file_type"),
        "access_count",
        "last_accessed",
        "frecency_score",
    )
    shares = _shares(with_usage(files, usage), "file_type")
    return shares.where("file_type <> ''") if windows else shares


def app_popularity(catalog: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Share of each application name in all picks of applications: ``(app_name, share)``."""
    apps = catalog.where("entry_type = 'App'").select(
        "id", F.lower("name").alias("app_name"), "access_count", "last_accessed", "frecency_score"
    )
    return _shares(with_usage(apps, usage), "app_name")
