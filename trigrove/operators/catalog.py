"""Catalog maintenance: merging, replacing, dropping subtrees and applying changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.functions import paths
from trigrove.model import CATALOG, Profile, UNIX

COLUMNS = CATALOG.fieldNames()


def as_catalog(rows: DataFrame) -> DataFrame:
    """Rows with exactly the catalog's columns and types; absent columns are null or empty."""
    kept = []
    for f in CATALOG:
        column = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name in ("access_count", "last_accessed", "frecency_score"):
            column = F.coalesce(column, F.lit(0))
        kept.append(column.cast(f.dataType).alias(f.name))
    return rows.select(*kept)


def catalog_order() -> Column:
    """Place of a row in catalog order: by the batch it came with, then by its position in it. Nothing is added to
    positions, which may be 64-bit ids."""
    return F.struct(F.coalesce("generation", F.lit(0)).alias("generation"), F.coalesce("position", "id").alias("position"))


def _after(old: DataFrame, new: DataFrame, last: int | None = None) -> DataFrame:
    """``new`` in generations that follow those of ``old``, the latest of which is ``last`` if it is known."""
    following = F.lit(last + 1) if last is not None else old.agg(F.max(F.coalesce("generation", F.lit(0))).alias("last")).scalar() + 1
    return new.withColumn("generation", F.coalesce(following, F.lit(0)) + F.coalesce("generation", F.lit(0)))


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """First row per key; only one row per key and task is shuffled."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("first_place", place).where("first_place = 1").drop("first_place")


def merge_last(old: DataFrame, new: DataFrame, last: int | None = None) -> DataFrame:
    """Both catalogs by id: the later row wins and takes the place of the earlier one."""
    kept = as_catalog(old)
    rows = kept.unionByName(_after(kept, as_catalog(new), last)).withColumn("place", catalog_order())
    merged = rows.groupBy("id").agg(F.min("place").alias("place"), F.max_by(F.struct(*COLUMNS), "place").alias("row"))
    placed = ("position", "generation")
    return merged.select(*[F.col(f"place.{c}").alias(c) if c in placed else F.col(f"row.{c}").alias(c) for c in COLUMNS])


def replace_catalog(old: DataFrame, new: DataFrame, profile: Profile = UNIX) -> DataFrame:
    """Keep the files (and in the unix dialect the commands) of ``old``; the rest comes from ``new``.

    Of new rows the first with an id stays, then the first with a type and lower-cased name.
    In the windows dialect names are compared first, of equal ids the last stays, and rows of known ids keep their counters.
    """
    kept_types = ["File"] if profile.name == "windows" else ["File", "Command"]
    whole = as_catalog(old)
    kept = whole.where(F.col("entry_type").isin(*kept_types))
    fresh = _after(whole, as_catalog(new))
    by_name = [F.col("entry_type"), F.lower("name")]
    if profile.name == "windows":
        fresh = carry_usage(whole, first_by(fresh, by_name, [catalog_order()]))
        return first_by(kept.unionByName(fresh), ["id"], [F.desc(catalog_order())])
    fresh = first_by(fresh.join(kept.select("id"), "id", "left_anti"), ["id"], [catalog_order()])
    return kept.unionByName(first_by(fresh, by_name, [catalog_order()]).select(*COLUMNS))


def replace_files(old: DataFrame, files: DataFrame, profile: Profile = UNIX) -> DataFrame:
    """All file rows come from ``files``, the others stay; equal ids keep the later row. In the windows dialect files of known ids
    keep their counters."""
    whole = as_catalog(old)
    fresh = _after(whole, as_catalog(files))
    fresh = carry_usage(whole, fresh) if profile.name == "windows" else fresh
    rows = whole.where("entry_type <> 'File'").unionByName(fresh)
    return first_by(rows, ["id"], [F.desc(catalog_order())])


def carry_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of known ids go over to their new rows."""
    counters = ["access_count", "last_accessed", "frecency_score"]
    known = old.select("id", *[F.col(c).alias(f"old_{c}") for c in counters])
    joined = as_catalog(new).join(known, "id", "left")
    return joined.withColumns({c: F.coalesce(f"old_{c}", c) for c in counters}).select(*COLUMNS)


def expand_home(path: Column, home: str) -> Column:
    inside = F.concat(F.lit(home.rstrip("/") + "/"), F.substr(path, F.lit(3)))
    return F.when(path == "~", F.lit(home)).when(path.startswith("~/"), inside).otherwise(path)


def distinct_roots(roots: DataFrame, home: str | None = None, caseless: bool = False) -> DataFrame:
    """Roots without repeats and without roots inside another one.

    Each root looks for its own ancestors among the roots with an equi-join.
    """
    path = F.col("path") if home is None else expand_home(F.col("path"), home)
    cleaned = roots.select(paths.clean(path).alias("path"))
    key = F.lower(F.translate("path", "\\", "/")) if caseless else F.col("path")
    known = cleaned.withColumn("key", key).groupBy("key").agg(F.min("path").alias("path"))
    above = known.select(F.col("key").alias("inner_key"), F.explode(paths.ancestors(F.col("key"))).alias("key")).where(
        "key <> inner_key"
    )
    inner = above.join(known.select("key"), "key").select(F.col("inner_key").alias("key")).distinct()
    return known.join(inner, "key", "left_anti").select("path")


def path_key(column: str, profile: Profile) -> Column:
    """A path as compared: clean, and in the windows dialect with "/" between components and without case."""
    path = F.col(column)
    return paths.clean(F.lower(F.translate(path, "\\", "/")) if profile.caseless_paths else path)


def _subtree_ids(catalog: DataFrame, removed: DataFrame, profile: Profile) -> DataFrame:
    key = lambda c: path_key(c, profile)
    gone = removed.select(key("path").alias("key")).distinct()
    whole = catalog.select("id", key("path").alias("path"), "entry_type")
    above = paths.ancestors(F.col("path"))
    if profile.name == "windows":
        above = F.when(F.col("entry_type") == "File", above).otherwise(F.array("path"))
    under = whole.select("id", F.explode(above).alias("key")).join(gone, "key").select("id")
    return under if profile.name == "windows" else under.unionByName(made_from(removed, profile))


def made_from(files: DataFrame, profile: Profile = UNIX) -> DataFrame:
    """Ids of the applications and settings that are made from files of these paths."""
    ids = [paths.stable_id(F.lit(t), F.col("path"), profile.caseless_paths) for t in ("App", "Setting")]
    return files.select(F.explode(F.array(*ids)).alias("id"))


def drop_subtrees(catalog: DataFrame, removed: DataFrame, profile: Profile = UNIX) -> DataFrame:
    """Catalog without entries at or below the ``removed`` paths, or made from a file there.

    Entries look for their own ancestor paths among the removed ones: an equi-join, not a
    comparison of every entry with every path.
    """
    return catalog.join(_subtree_ids(catalog, removed, profile).distinct(), "id", "left_anti")


def file_rows(listing: DataFrame, profile: Profile = UNIX) -> DataFrame:
    """Catalog rows of listed files and directories ``(path, size, is_dir)``."""
    windows = profile.name == "windows"
    is_dir = F.coalesce("is_dir", F.lit(False))
    slashed = F.translate("path", "\\", "/") if windows else F.col("path")
    kind = F.lower(paths.extension(slashed))
    size = F.col("size").cast("long")
    category = F.lit(None).cast("string")
    if windows:
        kind = F.when(~is_dir, F.coalesce(kind, F.lit("")))
        size = F.when(~is_dir, size)
        category = F.when(is_dir, F.lit("Folder")).otherwise(F.lit("File"))
    metadata = F.struct(
        kind.alias("file_type"), size.alias("file_size"), is_dir.alias("is_dir"),
        F.array().cast("array<string>").alias("tags"), category.alias("category"),
    )
    rows = listing.select(
        paths.stable_id(F.lit("File"), F.col("path"), profile.caseless_paths).alias("id"),
        F.lit("File").alias("entry_type"),
        paths.base_name(slashed).alias("name"),
        F.col("path"),
        metadata.alias("metadata"),
        (F.col("position") if "position" in listing.columns else F.lit(None)).cast("long").alias("position"),
    )
    return as_catalog(rows)


def coalesce_changes(changes: DataFrame, profile: Profile = UNIX) -> DataFrame:
    """Latest change of each path in a batch."""
    return first_by(changes, [path_key("path", profile) if profile.caseless_paths else F.col("path")], [F.desc("seq")])


def changed_rows(
    changes: DataFrame, *, listing: DataFrame | None = None, desktop_files: DataFrame | None = None, profile: Profile = UNIX
) -> DataFrame:
    """The catalog rows that a batch of changes brings, by the rules of ``apply_changes``; they do not depend on the catalog."""
    from trigrove.sources.desktop import desktop_entries

    key = path_key("path", profile)
    keyed = changes.withColumn("key", key)
    removed = keyed.where("kind = 'Removed'").groupBy(F.col("key").alias("above")).agg(F.max("seq").alias("gone_at"))

    def there(rows: DataFrame) -> DataFrame:
        lost = (
            rows.select("key", "seq", F.explode(paths.ancestors(F.col("key"))).alias("above"))
            .join(removed, "above")
            .where("gone_at > seq")
            .select("key")
            .distinct()
        )
        return rows.join(lost, "key", "left_anti")

    latest = first_by(keyed, ["key"], [F.desc("seq")]).where("kind <> 'Removed'")
    added = there(latest.select("key", "path", "seq", "is_dir", "size", "kind"))
    rows = added.select("key", "path", "seq", "is_dir", "size", F.lit(0).alias("listed"))
    if listing is not None:
        new_dirs = added.where("kind = 'Created' and is_dir").select(F.col("key").alias("above"), "seq")
        below = (
            listing.select(key.alias("key"), "path", "is_dir", "size")
            .select("*", F.explode(paths.ancestors(F.col("key"))).alias("above"))
            .where("above <> key")
            .join(new_dirs, "above")
            .groupBy("key")
            .agg(F.max("seq").alias("seq"), F.min("path").alias("path"), F.first("is_dir").alias("is_dir"), F.first("size").alias("size"))
        )
        rows = rows.unionByName(there(below).withColumn("listed", F.lit(1)))
    rows = first_by(rows, ["key"], ["listed"]).withColumn("position", F.col("seq"))
    if profile.name == "windows":  # a desktop file is a file like others
        return file_rows(rows, profile)
    is_desktop = F.col("path").endswith(".desktop")
    if desktop_files is None:
        lost = F.raise_error(F.concat(F.lit("desktop_files is needed for the change of "), F.col("path")))
        return file_rows(rows.where(F.when(is_desktop, lost.cast("boolean")).otherwise(True)), profile)
    texts = desktop_files.join(rows.where(is_desktop).select("path", "position"), "path")
    return file_rows(rows.where(~is_desktop), profile).unionByName(as_catalog(desktop_entries(texts)))


def without_changed(catalog: DataFrame, changes: DataFrame, profile: Profile = UNIX) -> DataFrame:
    """Catalog rows that a batch of changes leaves: none below what is removed or created, none of a path that is changed itself."""
    key = path_key("path", profile)
    clear = drop_subtrees(catalog, changes.where("kind in ('Removed', 'Created')").select("path"), profile)
    return clear.withColumn("key", key).join(changes.select(key.alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def apply_changes(
    catalog: DataFrame,
    changes: DataFrame,
    *,
    listing: DataFrame | None = None,
    desktop_files: DataFrame | None = None,
    profile: Profile = UNIX,
) -> DataFrame:
    """Catalog after a batch of changes ``(seq, kind, path, is_dir, size)``.

    Removed drops the whole subtree. Created drops it too, then adds the path's row and, from
    ``listing``, what lies below it. Modified replaces the path's own row. A path counts as there
    unless it or a directory above it is removed later in the batch. Rows of desktop files come
    from ``desktop_files`` ``(path, value)``; without it a created or modified one is an error, except
    in the windows dialect, where it is a file like others. There paths are compared without case and with either slash.
    """
    come = changed_rows(changes, listing=listing, desktop_files=desktop_files, profile=profile)
    return merge_last(without_changed(catalog, changes, profile), come)
