"""Click logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "string"


def click_lines(clicks: DataFrame) -> DataFrame:
    """Clicks as JSON lines in the column ``value``; an empty candidate list is left out."""
    columns = [c for c in ("query", "selected_id", "selected_name", "timestamp", "context", "rank_position") if c in clicks.columns]
    fields = [F.col(c) for c in columns]
    if "candidates" in clicks.columns:
        fields.append(F.when(F.size("candidates") > 0, F.col("candidates")).alias("candidates"))
    return clicks.select(F.to_json(F.struct(*fields)).alias("value"))


def append_clicks(clicks: DataFrame, path: str) -> None:
    click_lines(clicks).write.mode("append").text(path)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Non-blank lines with ``json``, a variant that is null where the line is no JSON object.

    Variants keep 64-bit unsigned ids whole, whether written as numbers or as text.
    """
    kept = lines.where(F.col(column).rlike(r"\S"))
    parsed = F.try_parse_json(column)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return kept.withColumn("json", F.when(is_object, parsed))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block, place)`` of every line at ``path``: its file, where the block that it was read in starts, and a number
    that grows from line to line of a block."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows``, some of the placed lines ``lines``, with ``line``: the number in its file, from 1, blank lines counted.

    A file is read in blocks by many tasks, and none knows what lies before its own. Lines are counted for each block, partly
    before the shuffle; the counts of the earlier blocks of the file, one row for each block, give the number of the first line. Of
    the lines themselves only ``rows`` are shuffled. Numbers in a block start anywhere, as a task reads several blocks.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.join(starts, ["file", "block"]).withColumn("line", F.col("before") + F.col("place") - F.col("first") + 1)
    return numbered.drop("block", "place", "first", "before")


def read_clicks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(clicks, malformed)`` of the log files at ``path``; blank lines are in neither.

    Malformed lines keep their file, number in it and text.
    """
    lines = placed_lines(spark, path)
    parsed = parse_lines(lines)
    bad = with_line_numbers(parsed.where("json is null").drop("json"), lines)
    return clicks_of(parsed), bad.select("file", "line", "value")


def _get(path: str, kind: str):
    return F.try_variant_get("json", path, kind)


def clicks_of(parsed: DataFrame) -> DataFrame:
    """Click columns from parsed lines. Candidates stay variants, as writers differ in their fields."""
    return parsed.where("json is not null").select(
        _get("$.query", "string").alias("query"),
        _get("$.selected_id", "string").alias("selected_id"),
        _get("$.selected_name", "string").alias("selected_name"),
        _get("$.timestamp", "long").alias("timestamp"),
        _get("$.rank_position", "int").alias("rank_position"),
        F.struct(
            _get("$.context.active_app", "string").alias("active_app"),
            _get("$.context.cwd", "string").alias("cwd"),
            _get("$.context.timestamp", "long").alias("timestamp"),
            _get("$.context.hour_of_day", "int").alias("hour_of_day"),
            _get("$.context.day_of_week", "int").alias("day_of_week"),
        ).alias("context"),
        _get("$.candidates", "array<variant>").alias("candidates"),
    )


def click_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
