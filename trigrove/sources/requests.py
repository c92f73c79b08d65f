"""Request rows: newline-delimited JSON, each a query or a click."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.model import MAX_REQUEST
from trigrove.sources.clicklog import parse_lines


def read_requests(lines: DataFrame, max_length: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(queries, clicks, errors)`` from text rows ``value`` (other columns pass through).

    A row with ``selected_id`` is a click and needs ``query``, an unsigned 64-bit id and a
    ``rank_position``; any other needs ``query``. A bad row becomes an error row and the rest go
    on. The windows dialect also rejects rows longer than ``MAX_REQUEST``.
    """
    others = [c for c in lines.columns if c != "value"]
    field = lambda path, kind: F.try_variant_get("json", path, kind)
    parsed = parse_lines(lines).select(
        *others,
        "value",
        F.col("json").isNotNull().alias("is_json"),
        F.coalesce(field("$", "map<string,variant>"), F.expr("map()").cast("map<string,variant>")).alias("fields"),
        field("$.query", "string").alias("query"),
        field("$.selected_id", "string").alias("selected_id"),
        field("$.rank_position", "int").alias("rank_position"),
    )
    is_click = F.map_contains_key("fields", "selected_id")
    good_id = F.coalesce(F.col("selected_id").rlike(r"^\d+$"), F.lit(False)) & (
        F.coalesce(F.expr("try_cast(selected_id as decimal(38,0))"), F.lit(-1)).between(
            F.lit(0), F.lit("18446744073709551615").cast("decimal(38,0)")
        )
    )
    good_rank = F.coalesce(F.col("rank_position").between(0, 255), F.lit(False))
    error = F.when(~F.col("is_json"), F.lit("invalid request"))
    if max_length is not None:
        error = F.when(F.length("value") > max_length, F.lit("request is too large")).otherwise(error)
    error = F.coalesce(
        error,
        F.when(is_click & ~(F.col("query").isNotNull() & good_id & good_rank), F.lit("invalid click request")),
        F.when(~is_click & F.col("query").isNull(), F.lit("invalid query request")),
    )
    judged = parsed.withColumns({"error": error, "is_click": is_click})
    queries = judged.where("error is null and not is_click").select(*others, "query")
    clicks = judged.where("error is null and is_click").select(*others, "query", "selected_id", "rank_position")
    return queries, clicks, judged.where("error is not null").select(*others, "value", "error")


__all__ = ["MAX_REQUEST", "read_requests"]
