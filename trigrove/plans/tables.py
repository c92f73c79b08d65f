"""The given tables seen as a catalog, usage and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import paths

# Moment at which usage is judged: 2024-01-31 00:00:00 UTC.
NOW = 1_706_659_200

# Each source has its own range of ids, wide enough at any scale.
ID_RANGE = 1_000_000_000_000_000
SOURCES = ("part", "supplier", "pages", "documents", "nation", "region")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(source: str, key: str) -> Column:
    return (F.col(key).cast("long") + F.lit(SOURCES.index(source) * ID_RANGE)).alias("id")


def _entry(rows: DataFrame, source: str, key: str, entry_type: str, name, path, *, file_type=None, size=None,
           tags=None, category=None) -> DataFrame:
    def text(value):
        return (F.lit(None) if value is None else value).cast("string")

    empty = F.array().cast("array<string>")
    metadata = F.struct(
        text(file_type).alias("file_type"),
        (F.lit(None) if size is None else size).cast("long").alias("file_size"),
        F.lit(False).alias("is_dir"),
        (empty if tags is None else tags).alias("tags"),
        text(category).alias("category"),
    )
    return rows.select(
        _id(source, key),
        F.lit(entry_type).alias("entry_type"),
        name.alias("name"),
        path.alias("path"),
        F.lit(None).cast("string").alias("icon_path"),
        F.lit(0.0).alias("frecency_score"),
        F.lit(0).cast("long").alias("last_accessed"),
        F.lit(0).cast("long").alias("access_count"),
        metadata.alias("metadata"),
        F.lit(None).cast("long").alias("position"),
        F.lit(None).cast("long").alias("generation"),
    )


def page_path(url: Column) -> Column:
    """Address without scheme, query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"/*([?#].*)?$", "")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as applications, pages and documents as files, nations as settings, regions as commands."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    pages = read(spark, sf_dir, "pages").select("page_id", page_path(F.col("url")).alias("path"))
    documents = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    nation = read(spark, sf_dir, "nation")
    region = read(spark, sf_dir, "region")
    key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    doc_name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    located = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    parts = [
        _entry(part, "part", "p_partkey", "App", F.col("p_name"), key("part/", "p_partkey"),
               tags=F.array(F.translate("p_brand", "#", " ")), category=F.col("p_type")),
        _entry(supplier, "supplier", "s_suppkey", "App", F.col("s_name"), key("supplier/", "s_suppkey")),
        _entry(pages, "pages", "page_id", "File", paths.base_name(F.col("path")), F.col("path"),
               file_type=F.lower(paths.extension(F.col("path")))),
        _entry(documents, "documents", "doc_id", "File", doc_name, F.concat(F.col("source"), F.lit("/"), doc_name),
               file_type=F.col("lang"), size=F.col("n_chars")),
        _entry(located, "nation", "n_nationkey", "Setting", F.translate("n_name", "_", " "),
               key("nation/", "n_nationkey"), category=F.col("r_name")),
        _entry(region, "region", "r_regionkey", "Command", F.col("r_name"), key("region/", "r_regionkey")),
    ]
    whole = parts[0]
    for rows in parts[1:]:
        whole = whole.unionByName(rows)
    return whole


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without time zone, taken as UTC whatever the session's zone is."""
    whole_days = F.unix_date(F.to_date(ts)).cast("long") * 86_400
    return whole_days + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


PICKS = ("click", "view", "purchase")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pick as ``(entry_id, ts, seq)``: an event picks a part by its property and a document by its user."""
    picked = (
        read(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*PICKS))
        .select(
            seconds(F.col("ts")).alias("ts"),
            F.col("event_id").alias("seq"),
            F.array(
                F.get_json_object("props", "$.k").cast("long"),
                F.col("user_id") + F.lit(SOURCES.index("documents") * ID_RANGE),
            ).alias("ids"),
        )
    )
    return picked.select(F.explode("ids").alias("entry_id"), "ts", "seq")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trigrove.operators.usage import access_counts

    return access_counts(accesses(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_of(catalog(spark, sf_dir))


def queries_of(entries: DataFrame) -> DataFrame:
    """One query per distinct entry name, one more with its second letter left out, and the empty query."""
    spark = entries.sparkSession
    names = entries.select("name").distinct()
    asked = names.select(
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("as is: "), "name").alias("query_id"), F.col("name").alias("query")),
                F.struct(
                    F.concat(F.lit("typo: "), "name").alias("query_id"),
                    F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)")).alias("query"),
                ),
            )
        ).alias("q")
    ).select("q.*")
    empty = spark.range(1).select(F.lit("empty").alias("query_id"), F.lit("  ").alias("query"))
    return in_context(asked.unionByName(empty))


def in_context(asked: DataFrame) -> DataFrame:
    """``(query_id, query)`` with a context that follows from the text."""
    size = F.length("query")
    return asked.select(
        "query_id",
        "query",
        F.when(size % 2 == 0, F.concat(F.lit("In "), F.col("query"))).alias("active_app"),
        F.concat(F.lit("src"), (size % 20).cast("string")).alias("cwd"),
        (F.lit(NOW) - size * 3600).cast("long").alias("timestamp"),
        (size % 24).cast("int").alias("hour_of_day"),
        (size % 7).cast("int").alias("day_of_week"),
    )
