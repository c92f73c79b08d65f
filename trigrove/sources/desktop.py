"""Desktop entry files: key = value text describing an application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import paths, text

KEYS = (
    "Type", "Hidden", "Name", "NoDisplay", "Categories", "GenericName", "Comment", "Keywords", "Exec", "Icon",
)
# Start of the file names of settings panels (fixed value).
SETTINGS_PREFIX = "com.system76.CosmicSettings"
MAX_DEPTH = 4


def read_desktop_files(spark: SparkSession, dirs: list[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(path, value, position)`` of the desktop files at most ``max_depth`` levels below each directory.

    A file below several directories is read once, at its first place.
    """
    found = None
    for order, folder in enumerate(dirs):
        root = paths.clean(F.regexp_replace(F.lit(folder), r"^file:/+", "/"))
        files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.desktop").select(
            F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^file:/+", "/").alias("path"),
            "value",
            F.lit(order).cast("long").alias("position"),
        )
        depth = F.size(F.split(F.substr("path", F.length(root) + 2), "/"))
        files = files.where(depth <= max_depth)
        found = files if found is None else found.unionByName(files)
    return found.groupBy("path").agg(F.min("position").alias("position"), F.first("value").alias("value"))


def _values(value: Column) -> Column:
    """First value of each known key in the main section, as a struct; other sections are passed over."""
    start = F.struct(F.lit(False).alias("inside"), *[F.lit(None).cast("string").alias(k) for k in KEYS])

    def step(seen: Column, raw: Column) -> Column:
        def take(line: Column) -> Column:
            heading = line.startswith("[")
            inside = F.when(heading, line == "[Desktop Entry]").otherwise(seen["inside"])
            usable = seen["inside"] & ~heading & ~line.startswith("#") & line.contains("=")
            key = F.substring_index(line, "=", 1)
            found = F.substr(line, F.length(key) + 2)
            return F.struct(
                inside.alias("inside"),
                *[F.coalesce(seen[k], F.when(usable & (key == k), found)).alias(k) for k in KEYS],
            )

        return F.get(F.transform(F.array(text.trim_space(raw)), take), F.lit(0))

    return F.aggregate(F.split(value, "\n"), start, step)


def _listed(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), text.trim_space)
    return F.filter(parts, lambda p: p != "")


def desktop_entries(files: DataFrame) -> DataFrame:
    """Catalog rows of desktop files ``(path, value)``; hidden and foreign ones are left out."""
    stem = paths.stem(F.col("path"))
    kept = files.withColumn("v", _values(F.col("value"))).withColumn("desktop_id", stem)
    panel = F.col("desktop_id").startswith(SETTINGS_PREFIX)
    kept = kept.where(
        (F.coalesce("v.Type", F.lit("Application")) == "Application")
        & (F.coalesce("v.Hidden", F.lit("")) != "true")
        & F.col("v.Name").isNotNull()
        & ((F.coalesce("v.NoDisplay", F.lit("")) != "true") | panel)
    )
    in_settings = F.exists(F.split(F.coalesce("v.Categories", F.lit("")), ";"), lambda c: F.lower(c) == "settings")
    entry_type = F.when(panel | in_settings, "Setting").otherwise("App")
    program = F.regexp_extract(F.coalesce("v.Exec", F.lit("")), r"(?U)^\s*(\S+)", 1)
    program = F.regexp_replace(program, r"^['\"]+|['\"]+$", "")
    program = F.translate(F.when(program != "", paths.base_name(program)).otherwise(F.lit("")), "-_", "  ")
    tags = F.concat(
        _listed(F.col("v.GenericName")),
        _listed(F.col("v.Comment")),
        _listed(F.col("v.Keywords")),
        F.filter(F.array(program), lambda p: p != ""),
        F.array(F.translate("desktop_id", "-_.", "   ")),
        text.aliases(F.col("v.Name")),
    )
    metadata = F.struct(
        F.lit(None).cast("string").alias("file_type"),
        F.lit(None).cast("long").alias("file_size"),
        F.lit(False).alias("is_dir"),
        text.distinct_tags(tags, F.col("v.Name")).alias("tags"),
        F.col("v.Categories").alias("category"),
    )
    position = F.col("position") if "position" in files.columns else F.lit(None)
    return kept.select(
        paths.stable_id(entry_type, F.col("path")).alias("id"),
        entry_type.alias("entry_type"),
        F.col("v.Name").alias("name"),
        F.col("desktop_id").alias("path"),
        F.col("v.Icon").alias("icon_path"),
        F.lit(0.0).alias("frecency_score"),
        F.lit(0).cast("long").alias("last_accessed"),
        F.lit(0).cast("long").alias("access_count"),
        metadata.alias("metadata"),
        position.cast("long").alias("position"),
        F.lit(None).cast("long").alias("generation"),
    )
