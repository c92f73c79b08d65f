"""The whole way from a table of queries to ranked results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.functions import paths, text
from trigrove.model import Profile, profile_of
from trigrove.operators import candidates as C
from trigrove.operators import intent as I
from trigrove.operators import rank as R
from trigrove.operators.index import LookupTables
from trigrove.operators.usage import daily_frecency, file_type_popularity, with_usage
from trigrove.plans.shared import written

CONTEXT = {
    "active_app": "string",
    "cwd": "string",
    "timestamp": "long",
    "hour_of_day": "int",
    "day_of_week": "int",
}


@dataclass(frozen=True)
class Steps:
    """Intermediate tables of a search, each a lazy DataFrame."""

    texts: DataFrame
    intents: DataFrame
    routes: DataFrame
    search_grams: DataFrame
    hits: DataFrame
    candidates: DataFrame
    stage1: DataFrame


def distinct_texts(queries: DataFrame) -> DataFrame:
    return queries.select(text.normalise(F.col("query")).alias("text")).distinct()


def retrieve(
    queries: DataFrame,
    tables: LookupTables,
    usage: DataFrame | None,
    *,
    now: int,
    stage1_limit: int | None = None,
    top_k: int = R.TOP,
    profile: str | Profile = "default",
    class_filter: str = "All",
    broadcast: bool | None = None,
) -> Steps:
    """Candidates of every distinct text, best first. Writes the lookups of the texts to the shared
    folder; all else is left to the caller's action.

    ``broadcast`` says whether the lookup side is small enough for every task; by default this
    is found out by looking at no more than ``BROADCAST_TEXTS`` + 1 queries.
    """
    p = profile_of(profile)
    most = tables.max_candidates
    limit = stage1_limit or max(p.stage1_limit or most, top_k)
    pre_filter = class_filter if p.class_filter_stage == "pre" else "All"
    texts = distinct_texts(queries).where("text <> ''")
    if broadcast is None:
        broadcast = C.fits_broadcast(queries.select(F.coalesce("query", F.lit("")).alias("text")))
    intents = I.classify(texts, tables.app_terms, tables.extensions, tables.setting_words, p)
    # Everything below starts from the lookups of the texts, several times; they are small, so they are
    # written once instead of being worked out from the queries for each use.
    routes = written(I.route(intents, p, pre_filter), "routes")
    search_rows = C.searches(routes)
    tables = tables.for_searches(search_rows)
    search_grams = C.ranked_grams(search_rows, tables.gram_counts)
    found = C.search_hits(tables, search_grams, most, broadcast)
    if p.exact_scope == "filter":
        classes = F.array(*[F.lit(c) for c in I.FILTER_CLASSES[pre_filter]])
        exact_lookups = texts.select("text", F.explode(classes).alias("entry_class"))
    else:
        exact_lookups = routes.select("text", "entry_class")
    exact = with_usage(C.exact_hits(tables.exact_terms, exact_lookups), usage)
    # Usage is joined to what the searches found, far fewer rows than the hits of all texts.
    found = with_usage(found, usage)
    hits = C.text_hits(routes, found, search_rows).unionByName(exact).repartition("text")
    union = C.candidate_union(C.fuzzy_pool(hits, most))
    # One shuffle by text serves the pool limit, the union and the order of stage 1.
    daily = daily_frecency(now, p.zero_count_uses_score)
    best = C.best_text_hits(routes, found, search_rows, limit, p.quality, daily, R.name_order(p)).unionByName(exact).repartition("text")
    stage1 = R.stage1_order(C.candidate_union(C.fuzzy_pool(best, most)), now, limit, p)
    return Steps(texts, intents, routes, search_grams, hits, union, stage1)


def _described(rows: DataFrame, catalog: DataFrame, popularity: DataFrame, profile: Profile) -> DataFrame:
    """Add what ranking and display need of each entry; ids without an entry are dropped."""
    about = catalog.select(
        "id",
        "entry_type",
        "path",
        "icon_path",
        F.col("metadata.is_dir").alias("is_dir"),
        F.col("metadata.category").alias("category"),
        paths.entry_file_type(F.col("metadata.file_type"), F.col("path"), profile.name == "windows").alias("file_type"),
    )
    shares = popularity.select(F.col("file_type").alias("popular_type"), "share")
    if "entry_type" in rows.columns:
        rows = rows.drop("entry_type")
    return rows.join(about, "id").join(shares, F.col("file_type") == F.col("popular_type"), "left").drop("popular_type")


def with_context(queries: DataFrame) -> DataFrame:
    """Queries with their normalised text and every context column, absent ones as nulls."""
    cols = [
        (F.col(c) if c in queries.columns else F.lit(None)).cast(kind).alias(c) for c, kind in CONTEXT.items()
    ]
    return queries.select("query_id", "query", text.normalise(F.col("query")).alias("text"), *cols)


def ranked_rows(
    queries: DataFrame,
    tables: LookupTables,
    usage: DataFrame | None,
    *,
    now: int,
    top_k: int = R.TOP,
    stage1_limit: int | None = None,
    profile: str | Profile = "default",
    class_filter: str = "All",
    model=None,
    switches: R.FeatureSwitches = R.FeatureSwitches(),
    broadcast: bool | None = None,
) -> DataFrame:
    """Results with features; see :func:`search`."""
    p = profile_of(profile)
    pre_filter = class_filter if p.class_filter_stage == "pre" else "All"
    if top_k > min(stage1_limit or tables.max_candidates, tables.max_candidates):
        raise ValueError(f"top_k is {top_k}, more than the candidates that are kept")
    tables.check_profile(p)
    asked = with_context(queries)
    fits, may_be_empty = C.look_at(queries.select(F.coalesce("query", F.lit("")).alias("text")))
    broadcast = fits if broadcast is None else broadcast
    steps = retrieve(
        queries, tables, usage, now=now, stage1_limit=stage1_limit, top_k=top_k, profile=p, class_filter=class_filter,
        broadcast=broadcast,
    )
    kept = ["text", "id", "name", "terms", "access_count", "last_accessed", "frecency_score"]
    shown = steps.stage1.select(*kept)
    if may_be_empty:  # otherwise nobody asks for the best of the whole catalog
        shown = shown.unionByName(R.empty_query_top(tables.catalog, usage, now, p, pre_filter, max(R.TOP, top_k)).select(*kept))
    found = R.match_features(shown).drop("terms")
    popularity = file_type_popularity(tables.catalog, usage, p.name == "windows")
    found = _described(found, tables.catalog, popularity, p)
    rows = asked.join(found, "text").withColumn("features", R.features_struct(p, switches))
    scored = score_rows(rows, model)
    ranked = R.final_order(scored, top_k, p)
    if class_filter != "All" and p.class_filter_stage == "post":
        ranked = R.class_filter_rows(ranked, class_filter).withColumn("rank", F.col("shown")).drop("shown")
    return ranked.select(
        "query_id", "query", "rank", "id", "entry_type", "name", "path", "icon_path", "is_dir", "category",
        "access_count", "last_accessed", "frecency_score", "score", "features",
    )


def score_rows(rows: DataFrame, model=None) -> DataFrame:
    """Score by the model where one is given, else by the fixed formula."""
    if model is None:
        return rows.withColumn("score", R.fallback_score())
    return model.score(rows)


def search(
    queries: DataFrame,
    catalog: DataFrame,
    usage: DataFrame | None = None,
    *,
    now: int,
    max_candidates: int | None = None,
    stage1_limit: int | None = None,
    top_k: int = R.TOP,
    profile: str | Profile = "default",
    class_filter: str = "All",
    model=None,
    tables: LookupTables | None = None,
) -> DataFrame:
    """The best entries of ``catalog`` for every row of ``queries``.

    ``queries`` has ``query_id`` and ``query`` and may have the context columns; ``catalog``
    and ``usage`` are laid out as in :mod:`trigrove.model`. ``now`` is the time in epoch seconds
    at which usage is judged. Give ``tables`` to search stored lookup tables; they must have been made
    for the profile and hold ``max_candidates`` (100 unless given) entries of a shape.
    """
    p = profile_of(profile)
    if tables is None:
        tables = LookupTables.of(catalog, 100 if max_candidates is None else max_candidates, p)
    elif max_candidates is not None:
        tables = tables.limited(max_candidates)
    return ranked_rows(
        queries, tables, usage, now=now, top_k=top_k, stage1_limit=stage1_limit, profile=p,
        class_filter=class_filter, model=model,
    ).drop("features")
