"""File catalogs from listings, and application catalogs from shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import paths, text
from trigrove.model import Profile, UNIX, UNIX_EXCLUDES
from trigrove.operators.catalog import as_catalog, file_rows

SHORTCUTS = ("lnk", "url", "appref-ms", "exe")


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``(path, size, is_dir)`` of the files below the roots. Contents are not read. Hidden and
    underscore files and empty directories are not seen this way; give a listing table to have them."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(roots)
        .select(
            F.regexp_replace("path", r"^file:/+", "/").alias("path"),
            F.col("length").alias("size"),
            F.lit(False).alias("is_dir"),
        )
    )


def file_catalog(
    listing: DataFrame, roots: list[str], excludes=UNIX_EXCLUDES, profile: Profile = UNIX
) -> DataFrame:
    """Rows of every listed file below a root and of every directory from the root down to it.

    Paths with a hidden or excluded component are left out; a path below several roots or
    above many files gives one row, reduced before the shuffle.
    """
    windows = profile.name == "windows"
    rows = None
    path = F.col("path")
    slashed = F.translate(path, "\\", "/") if windows else path
    listed = listing.select(
        slashed.alias("path"), F.col("size").cast("long").alias("size"), F.coalesce("is_dir", F.lit(False)).alias("is_dir")
    )
    for root in roots:
        root = root.replace("\\", "/") if windows else root
        top = F.lit(root.rstrip("/") or "/")
        fold = F.lower if windows else (lambda c: c)
        inside = listed.where(paths.lies_under(fold(path), fold(top)))
        above = F.filter(
            paths.ancestors(F.coalesce(paths.parent(path), path)), lambda a: paths.lies_under(fold(a), fold(top))
        )
        folders = inside.select(F.explode(above).alias("path"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("is_dir"))
        found = inside.unionByName(folders).where(paths.scan_keeps(top, path, excludes, windows))
        rows = found if rows is None else rows.unionByName(found)
    unique = rows.groupBy("path").agg(F.max("size").alias("size"), F.max("is_dir").alias("is_dir"))
    return file_rows(unique, profile)


def shortcut_apps(listing: DataFrame) -> DataFrame:
    """Application rows of shortcut files ``(root, path)``: the parent folder and aliases are
    tags, the first folder below the root is the category."""
    # The filter is pushed to the scan and takes its expressions along, so each of them is bound once instead of being repeated.
    slashed = listing.select(
        "path", F.translate("path", "\\", "/").alias("slashed"), F.regexp_replace(F.translate("root", "\\", "/"), r"/+$", "").alias("root")
    )
    both = lambda n: F.struct(paths.stem_of_name(n).alias("name"), F.lower(paths.extension_of_name(n)).alias("extension"))
    named = slashed.withColumn("file", text.bound(F.col("slashed"), lambda s: text.bound(paths.base_name(s), both)))
    wanted = lambda f: f["extension"].isin(*SHORTCUTS) & (F.trim(f["name"]) != "") & (F.lower(f["name"]) != "uninstall")
    kept = named.where(text.bound(F.col("file"), wanted)).select("path", "slashed", "root", F.col("file.name").alias("name"))
    below = F.split(F.regexp_replace(F.substr("slashed", F.length("root") + 1), r"^/+", ""), "/")
    category = text.bound(below, lambda b: F.when(F.size(b) > 1, F.get(b, F.lit(0))).otherwise(F.lit("Applications")))
    folder = text.bound(F.col("slashed"), lambda s: text.bound(paths.parent(s), paths.base_name))
    tags = F.concat(F.array(folder), text.aliases(F.col("name"), windows=True))
    described = kept.select("path", "name", category.alias("category"), tags.alias("tags"))
    metadata = F.struct(
        F.lit(None).cast("string").alias("file_type"),
        F.lit(None).cast("long").alias("file_size"),
        F.lit(False).alias("is_dir"),
        text.distinct_tags(F.col("tags"), F.col("name"), windows=True).alias("tags"),
        "category",
    )
    return as_catalog(
        described.select(
            paths.stable_id(F.lit("App"), F.col("path"), caseless=True).alias("id"),
            F.lit("App").alias("entry_type"),
            "name",
            F.col("path"),
            F.col("path").alias("icon_path"),
            metadata.alias("metadata"),
        )
    )
