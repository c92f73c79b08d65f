"""Order of candidates, features and final scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.functions import paths, text
from trigrove.model import FEATURES, Profile, UNIX, parse_app_groups
from trigrove.operators.usage import DAY, DECAY, daily_frecency, with_usage

TOP = 10
CLASS_TYPES = {
    "All": ("App", "File", "Setting", "Command"),
    "Apps": ("App",),
    "Files": ("File",),
    "Settings": ("Setting", "Command"),
}
FILTERED_ROWS = 12
NEVER_USED_AGE = 30 * DAY


def name_order(profile: Profile) -> Column:
    return F.asc(F.upper("name")) if profile.name_order == "caseless" else F.asc("name")


def stage1_order(candidates: DataFrame, now: int, most: int, profile: Profile = UNIX) -> DataFrame:
    """The ``most`` best candidates of each text: match grade, decayed usage, name, id."""
    graded = candidates.withColumns(
        {
            "quality": text.match_quality(F.col("text"), F.col("terms"), profile.quality),
            "daily": daily_frecency(now, profile.zero_count_uses_score),
        }
    )
    order = Window.partitionBy("text").orderBy(F.desc("quality"), F.desc("daily"), name_order(profile), F.asc("id"))
    return graded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def empty_query_top(
    catalog: DataFrame, usage: DataFrame | None, now: int, profile: Profile = UNIX, class_filter: str = "All", most: int = TOP
) -> DataFrame:
    """What an empty query shows: the ``most`` most used entries, then by name and id.

    A limit over an order keeps as many rows per task, so nothing is sorted whole.
    """
    rows = catalog.select(
        "id", "name", "entry_type", text.lower_terms(F.col("name"), F.col("metadata.tags")).alias("terms"),
        "access_count", "last_accessed", "frecency_score",
    )
    if profile.class_filter_stage == "pre":
        rows = rows.where(F.col("entry_type").isin(*CLASS_TYPES[class_filter]))
    rows = with_usage(rows, usage).withColumn("daily", daily_frecency(now, profile.zero_count_uses_score))
    best = rows.orderBy(F.desc("daily"), name_order(profile), F.asc("id")).limit(most)
    return best.withColumns({"text": F.lit(""), "quality": F.lit(0)})


def match_features(rows: DataFrame) -> DataFrame:
    """Features that depend on text and entry only; they are computed once per distinct text."""
    query_grams = text.trigrams(F.col("text"))
    entry_grams = text.terms_trigrams(F.col("terms"))
    return rows.withColumns(
        {
            "distance": text.least_distance(F.col("text"), F.col("terms")),
            "is_exact_prefix": text.has_prefix(F.col("text"), F.col("terms")),
            "is_trigram_match": text.overlap(query_grams, entry_grams) >= text.MATCH_OVERLAP,
        }
    )


@dataclass(frozen=True)
class FeatureSwitches:
    """Groups of features that can be switched off; an off feature is 0."""

    time_of_day: bool = True
    active_app: bool = True
    working_directory: bool = True
    file_type_popularity: bool = True


def active_app_match(profile: Profile = UNIX) -> Column:
    """The application in use has the entry's name or works on its file type."""
    app, name = F.lower("active_app"), F.lower("name")
    by_type = F.lit(False)
    for apps, kinds in parse_app_groups(profile.app_groups):
        used = F.lit(False)
        for token in apps:
            used = used | app.contains(token)
        by_type = by_type | (used & F.col("file_type").isin(*kinds))
    same_name = app.contains(name) | name.contains(app)
    matched = F.when(F.col("entry_type").isin(*profile.app_like_types), same_name).otherwise(by_type)
    if profile.name == "windows":
        matched = F.when(F.trim("active_app") != "", matched)
    return F.coalesce(matched, F.lit(False))


def same_directory(profile: Profile = UNIX) -> Column:
    """The working directory is the entry's path or contains it directly."""
    where = paths.clean(F.col("cwd"), profile.caseless_paths)
    path = paths.clean(F.col("path"), profile.caseless_paths)
    same = (path == where) | (paths.parent(path) == where)
    if profile.caseless_paths:
        same = F.when((where != "") & (path != ""), same)
    return F.coalesce(same, F.lit(False))


def _unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def feature_columns(profile: Profile = UNIX, switches: FeatureSwitches = FeatureSwitches()) -> dict[str, Column]:
    """The twelve features, in model order, all in [0, 1].

    Reads the match features, the entry's counters, type, path and file type, the query's
    context and ``share``, the popularity of the file type.
    """
    count = F.coalesce(F.col("access_count"), F.lit(0))
    last = F.coalesce(F.col("last_accessed"), F.lit(0))
    age = F.when(last == 0, F.lit(NEVER_USED_AGE).cast("long")).otherwise(
        F.greatest(F.coalesce(F.col("timestamp"), F.lit(0)) - last, F.lit(0))
    )
    raw = F.when(count == 0, F.greatest(F.coalesce("frecency_score", F.lit(0.0)), F.lit(0.0))).otherwise(
        count * F.pow(F.lit(DECAY), age / DAY)
    )
    finite = (raw > 0) & ~F.isnan(raw) & (raw < F.lit(float("inf")))
    distance = F.col("distance")

    def number(flag: Column) -> Column:
        return flag.cast("double")

    def when(on: bool, value: Column) -> Column:
        return value if on else F.lit(0.0)

    hour = F.least(F.coalesce("hour_of_day", F.lit(0)), F.lit(23)) / 23
    weekday = F.least(F.coalesce("day_of_week", F.lit(0)), F.lit(6)) / 6
    columns = {
        "is_exact_prefix": number(F.col("is_exact_prefix")),
        "is_trigram_match": number(F.col("is_trigram_match")),
        "is_levenshtein_match": number(distance <= text.MATCH_EDITS),
        "frecency": F.when(finite, _unit(raw / (raw + 10))).otherwise(F.lit(0.0)),
        "recency_hours": _unit(age / 3600 / 720),
        "access_count": _unit(F.log(count + F.lit(1.0)) / F.log(F.lit(1001.0))),
        "edit_distance": _unit(distance / text.EDIT_CAP),
        "time_hour_bucket": when(switches.time_of_day, _unit(hour)),
        "day_of_week": when(switches.time_of_day, _unit(weekday)),
        "active_app_match": when(switches.active_app, number(active_app_match(profile))),
        "same_directory": when(switches.working_directory, number(same_directory(profile))),
        "file_type_popularity": when(
            switches.file_type_popularity, _unit(F.coalesce("share", F.lit(0.0)))
        ),
    }
    return {name: columns[name].cast("double") for name in FEATURES}


def features_struct(profile: Profile = UNIX, switches: FeatureSwitches = FeatureSwitches()) -> Column:
    return F.struct(*[c.alias(n) for n, c in feature_columns(profile, switches).items()])


def fallback_score(features: str = "features") -> Column:
    """Fixed formula used without a model: match grade and decayed usage."""
    def of(name: str) -> Column:
        return F.col(f"{features}.{name}")

    grade = (
        F.when(of("is_exact_prefix") > 0, 1.0)
        .when(of("is_levenshtein_match") > 0, 0.9)
        .when(of("is_trigram_match") > 0, 0.7)
        .otherwise(0.0)
    )
    return _unit(grade * 0.85 + of("frecency") * 0.15)


#: What tells queries apart.
ASKED = ("query_id", "query", "active_app", "cwd", "timestamp", "hour_of_day", "day_of_week")


def final_order(scored: DataFrame, most: int = TOP, profile: Profile = UNIX) -> DataFrame:
    """The ``most`` best rows of each query: score, name, id. Rows of ``queries`` under one id that differ in text or context are
    queries of their own; rows that are alike get the same results, one rank for each."""
    keys = [c for c in ASKED if c in scored.columns]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), name_order(profile), F.asc("id"))
    return scored.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most)


def class_filter_rows(results: DataFrame, class_filter: str) -> DataFrame:
    """Class filter applied to ranked results: what remains keeps its order, at most twelve rows."""
    kept = results.where(F.col("entry_type").isin(*CLASS_TYPES[class_filter]))
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        kept.withColumn("shown", F.row_number().over(order))
        .where(F.col("shown") <= FILTERED_ROWS)
    )


def class_counts(results: DataFrame) -> DataFrame:
    """Results per class column of each query, and how many columns are not empty."""
    def among(*types: str) -> Column:
        return F.count_if(F.col("entry_type").isin(*types))

    counted = results.groupBy("query_id").agg(
        among("App").alias("apps"),
        among("File").alias("files"),
        among("Setting", "Command").alias("settings"),
    )
    filled = sum(((F.col(c) > 0).cast("int") for c in ("apps", "files", "settings")), F.lit(0))
    return counted.withColumn("filled_classes", filled)


def display_rows(results: DataFrame) -> DataFrame:
    """Rows as an interface shows them: id as text, and a line below the name."""
    above = paths.parent(F.col("path"))
    subtitle = F.when(
        F.col("entry_type").isin("App", "Setting"), F.coalesce("category", "path")
    ).otherwise(F.coalesce(above, F.col("path")))
    return results.select(
        "query_id", "rank", F.col("id").cast("string").alias("id"), "entry_type", "name", "path", "icon_path",
        "score", "frecency_score", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "category",
        subtitle.alias("subtitle"),
    )


def containing_folder(entries: DataFrame) -> DataFrame:
    """Folder to show for each file entry: a directory itself, else the directory around the file."""
    folder = F.when(F.coalesce("metadata.is_dir", F.lit(False)), F.col("path")).otherwise(
        F.coalesce(paths.parent(F.col("path")), F.col("path"))
    )
    return entries.where("entry_type = 'File'").select("id", "path", folder.alias("folder"))


def normal_type(entry_type: Column) -> Column:
    """Spelling of an entry type in any case; an unknown type fails the query."""
    normal = F.initcap(F.lower(entry_type))
    known = normal.isin("App", "File", "Setting", "Command")
    return F.when(known, normal).otherwise(F.raise_error(F.concat(F.lit("unknown entry type: "), F.coalesce(entry_type, F.lit("null")))))


def is_stale(last_indexed: Column, now: int) -> Column:
    """The catalog is older than a second."""
    return F.lit(int(now)) - last_indexed > 1
