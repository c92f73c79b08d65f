"""Lookup tables of a catalog.

Entries of one class with the same set of lower-cased terms match every query alike, so
they are kept as one *shape*. A third of the catalog may carry the same name: it still is one
row in every table below, and never one big group in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.functions import text
from trigrove.model import Profile, UNIX


ROWS_PER_FILE = 500_000


def entry_class(entry_type: Column) -> Column:
    return F.when(entry_type == "Command", F.lit("Setting")).otherwise(entry_type)


def entry_terms(catalog: DataFrame) -> DataFrame:
    """Entries with their class, their set of lower-cased terms and their own counters."""
    terms = text.lower_terms(F.col("name"), F.col("metadata.tags"))
    generation = F.coalesce("generation", F.lit(0)) if "generation" in catalog.columns else F.lit(0).cast("long")
    return catalog.select(
        entry_class(F.col("entry_type")).alias("entry_class"),
        "id",
        "name",
        F.array_sort(F.array_distinct(terms)).alias("terms"),
        F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
        F.coalesce("last_accessed", F.lit(0)).cast("long").alias("last_accessed"),
        F.coalesce("frecency_score", F.lit(0.0)).cast("double").alias("frecency_score"),
        F.struct(generation.alias("generation"), F.coalesce("position", "id").alias("position")).alias("position"),
    )


def shapes(entries: DataFrame, most: int) -> DataFrame:
    """One row per class and set of terms.

    ``shape_id`` is the smallest entry id and ``members`` the ``most`` smallest ids: no result
    that keeps ``most`` entries ordered by score and then id can need another one. Both sides of
    the join are grouped on the same keys, so it adds no shuffle; row limits run before the shuffle.
    """
    keys = ["entry_class", "terms"]
    counted = entries.groupBy(*keys).agg(F.min("id").alias("shape_id"), F.count("*").alias("n_entries"))
    first = entries.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(
        F.col("n") <= most
    )
    members = first.groupBy(*keys).agg(
        F.collect_list(F.struct("id", "name", "access_count", "last_accessed", "frecency_score")).alias("members")
    )
    return counted.join(members, keys).withColumn("grams", text.terms_trigrams(F.col("terms")))


def postings(shape_rows: DataFrame, *carried: str) -> DataFrame:
    """One row per gram of a shape."""
    return shape_rows.select("entry_class", "shape_id", *carried, F.explode("grams").alias("gram"))


def gram_counts(shape_rows: DataFrame) -> DataFrame:
    """Entries and shapes per class and gram."""
    return postings(shape_rows, "n_entries").groupBy("entry_class", "gram").agg(
        F.sum("n_entries").alias("entries"), F.count("*").alias("n_shapes")
    )


def exact_terms(entries: DataFrame) -> DataFrame:
    """Owner of each trimmed term of a class: of the entries that carry it, the last in the catalog."""
    spelled = entries.select(
        "entry_class",
        "position",
        F.struct("id", "name", "access_count", "last_accessed", "frecency_score", "terms").alias("owner"),
        F.explode(F.array_distinct(F.transform("terms", text.trim_space))).alias("term"),
    )
    return spelled.where("term <> ''").groupBy("entry_class", "term").agg(F.max_by("owner", "position").alias("owner"))


def app_terms(catalog: DataFrame, trimmed: bool = False) -> DataFrame:
    """Distinct lower-cased names and tags of applications."""
    words = text.lower_terms(F.col("name"), F.col("metadata.tags"))
    if trimmed:
        words = F.transform(words, text.trim_space)
    return catalog.where("entry_type = 'App'").select(F.explode(words).alias("term")).distinct()


def setting_words(catalog: DataFrame) -> DataFrame:
    """Distinct lower-cased words of setting names."""
    words = F.split(F.lower("name"), r"(?U)\s+")
    return (
        catalog.where("entry_type = 'Setting'")
        .select(F.explode(words).alias("word"))
        .where("word <> ''")
        .distinct()
    )


def extensions(catalog: DataFrame) -> DataFrame:
    """Distinct file types of files, lower-cased, without leading dots."""
    kind = F.lower(F.regexp_replace("metadata.file_type", r"^\.+", ""))
    return (
        catalog.where("entry_type = 'File' and metadata.file_type is not null")
        .select(kind.alias("extension"))
        .distinct()
    )


@dataclass
class LookupTables:
    """What a search reads besides the queries."""

    catalog: DataFrame
    shapes: DataFrame
    gram_counts: DataFrame
    exact_terms: DataFrame
    app_terms: DataFrame
    setting_words: DataFrame
    extensions: DataFrame
    max_candidates: int
    profile: str = UNIX.name
    NAMES = ("catalog", "shapes", "gram_counts", "exact_terms", "app_terms", "setting_words", "extensions")

    @classmethod
    def of(cls, catalog: DataFrame, max_candidates: int = 100, profile: Profile = UNIX) -> LookupTables:
        """Declare the tables over a catalog; nothing runs yet."""
        most = profile.max_candidates(max_candidates)
        entries = entry_terms(catalog)
        shape_rows = shapes(entries, most)
        return cls(
            catalog=catalog,
            shapes=shape_rows,
            gram_counts=gram_counts(shape_rows),
            exact_terms=exact_terms(entries),
            app_terms=app_terms(catalog, profile.trim_app_terms),
            setting_words=setting_words(catalog),
            extensions=extensions(catalog),
            max_candidates=most,
            profile=profile.name,
        )

    def limited(self, max_candidates: int) -> LookupTables:
        """The tables for searches of at most ``max_candidates``; they must hold as many."""
        if max_candidates > self.max_candidates:
            raise ValueError(f"the lookup tables hold {self.max_candidates} candidates of a shape, {max_candidates} are asked for")
        return replace(self, max_candidates=max_candidates)

    def for_searches(self, searches: DataFrame) -> LookupTables:
        """The tables for some searches; those that can tell read less."""
        return self

    def looked_up(self, lookups: DataFrame) -> tuple[LookupTables, DataFrame]:
        """The tables and the lookup rows of some searches, made ready to meet."""
        return self, lookups

    def posting_rows(self) -> DataFrame | None:
        """Stored rows of each gram's shapes, where there are any."""
        return None

    def check_profile(self, profile: Profile) -> None:
        if profile.name != self.profile:
            raise ValueError(f"the lookup tables are of the {self.profile} dialect, the search is of {profile.name}")

    def write(self, path: str) -> None:
        """Store the tables, split by class so that a search reads only the classes it is routed to."""
        split = {"shapes", "gram_counts", "exact_terms"}
        shape_path = f"{path}/shapes"
        spark = self.catalog.sparkSession
        for name in self.NAMES:
            table = getattr(self, name)
            if name == "gram_counts":  # from the written shapes, not from the catalog again
                table = gram_counts(spark.read.parquet(shape_path))
            if name == "shapes":  # one file per core and class at least, more as the table grows
                table = table.repartition(max(spark.sparkContext.defaultParallelism, 1 + self.shapes.count() // ROWS_PER_FILE), "shape_id")
            writer = table.write.mode("overwrite")
            if name in split:
                writer = writer.partitionBy("entry_class")
            writer.parquet(f"{path}/{name}")
        about = spark.createDataFrame([(self.max_candidates, self.profile)], "max_candidates int, profile string")
        about.coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def read(cls, spark, path: str, max_candidates: int | None = None, profile: Profile | None = None) -> LookupTables:
        """Stored tables with the cap and the dialect they were made with; asking for more, or for the other, is an error."""
        about = spark.read.schema("max_candidates int, profile string").json(f"{path}/about").first()
        tables = cls(**{name: spark.read.parquet(f"{path}/{name}") for name in cls.NAMES}, **about.asDict())
        if profile is not None:
            tables.check_profile(profile)
        return tables if max_candidates is None else tables.limited(max_candidates)
