"""What a query is after, and which classes it therefore searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.model import Profile, UNIX, parse_routes

PIECE = 3


def _pieces(value: Column) -> Column:
    """Distinct substrings of one to three characters."""
    def of_length(n: int) -> Column:
        starts = F.when(
            F.length(value) >= n, F.sequence(F.lit(1), F.greatest(F.length(value) - (n - 1), F.lit(1)))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(value, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(1, PIECE + 1)]))


def words_inside(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``(text, word)`` for the alphabetically first of ``words`` that each text contains.

    A contained word starts with one of the text's pieces, so an equi-join on the word's first
    three characters finds every pair; no text meets every word.
    """
    keyed = words.select("word", F.substring("word", 1, PIECE).alias("piece"))
    cut = texts.select("text", F.explode(_pieces(F.col("text"))).alias("piece"))
    return (
        cut.join(keyed, "piece")
        .where(F.col("text").contains(F.col("word")))
        .groupBy("text")
        .agg(F.min("word").alias("word"))
    )


def classify(
    texts: DataFrame,
    app_terms: DataFrame,
    extensions: DataFrame,
    setting_words: DataFrame,
    profile: Profile = UNIX,
) -> DataFrame:
    """``(text, intent, keyword)`` for distinct non-empty normalised texts.

    First that holds: the text is an application term; the part after its last dot is a known
    file type; it contains a setting word. The three tests are inner joins whose hits are
    gathered with one aggregation per text, so texts without a dot meet in no join.
    """
    after_dot = F.when(F.col("text").contains("."), F.substring_index("text", ".", -1))
    if profile.setting_words is not None:
        after_dot = F.when(after_dot != "", after_dot)
    none = F.lit(None).cast("string")

    def signal(rows: DataFrame, app=None, extension=None, word=None) -> DataFrame:
        pick = lambda c: none if c is None else c
        return rows.select("text", pick(app).alias("app"), pick(extension).alias("extension"), pick(word).alias("word"))

    fixed = none
    if profile.setting_words is not None:
        listed = F.array(*[F.lit(w) for w in profile.setting_words])
        fixed = F.array_min(F.filter(listed, lambda w: F.col("text").contains(w)))
    signals = signal(texts, word=fixed)
    signals = signals.unionByName(
        signal(texts.join(app_terms.select(F.col("term").alias("text")), "text"), app=F.lit("y"))
    )
    dotted = texts.select("text", after_dot.alias("extension")).where("extension is not null")
    signals = signals.unionByName(
        signal(dotted.join(extensions.select("extension"), "extension"), extension=F.col("extension"))
    )
    if profile.setting_words is None:
        signals = signals.unionByName(signal(words_inside(texts, setting_words), word=F.col("word")))
    found = signals.groupBy("text").agg(
        F.max("app").alias("app"), F.max("extension").alias("extension"), F.min("word").alias("word")
    )
    intent = (
        F.when(F.col("app").isNotNull(), "ExactApp")
        .when(F.col("extension").isNotNull(), "FileExtension")
        .when(F.col("word").isNotNull(), "Setting")
        .otherwise("Mixed")
    )
    keyword = (
        F.when(F.col("app").isNotNull(), F.col("text"))
        .when(F.col("extension").isNotNull(), F.col("extension"))
        .otherwise(F.col("word"))
    )
    return found.select("text", intent.alias("intent"), keyword.alias("keyword"))


def route(intents: DataFrame, profile: Profile = UNIX, class_filter: str = "All") -> DataFrame:
    """``(text, intent, single, entry_class, search_text, least)``: one row per lookup a text makes;
    ``single`` marks a text that makes only one."""
    def struct(group: str, source: str, least: float) -> Column:
        searched = F.col("keyword") if source == "keyword" else F.col("text")
        return F.struct(
            F.lit(group).alias("entry_class"), searched.alias("search_text"), F.lit(least).alias("least")
        )

    if profile.class_routes is not None and class_filter != "All":
        lookups = F.array(*[struct(*r) for r in parse_routes(profile.class_routes)[class_filter]])
    else:
        routes = parse_routes(profile.routes)
        lookups = None
        for intent, rows in routes.items():
            made = F.array(*[struct(*r) for r in rows])
            test = F.col("intent") == intent
            lookups = F.when(test, made) if lookups is None else lookups.when(test, made)
    return intents.select(
        "text", "intent", (F.size(lookups) == 1).alias("single"), F.explode(lookups).alias("lookup")
    ).select("text", "intent", "single", "lookup.*")


FILTER_CLASSES = {
    "All": ("App", "File", "Setting"),
    "Apps": ("App",),
    "Files": ("File",),
    "Settings": ("Setting",),
}
