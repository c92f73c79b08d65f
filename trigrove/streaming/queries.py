"""Query feed: every arriving query is answered from the current catalog and usage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trigrove.operators.index import LookupTables
from trigrove.plans.search import ranked_rows


def stream_queries(
    queries: DataFrame,
    tables: Callable[[], LookupTables],
    usage: Callable[[], DataFrame | None],
    sink: str,
    checkpoint: str,
    *,
    now: Callable[[], int],
    available_now: bool = False,
    interval: str = "500 milliseconds",
    **search_options,
) -> StreamingQuery:
    """Answer each micro-batch with the batch plan and write it to a folder of its own in ``sink``.

    Ranking windows are no streaming operators, so the plan runs once per batch; ``tables`` and
    ``usage`` are asked each time and may hand out newer versions.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        results = ranked_rows(batch, tables(), usage(), now=now(), **search_options).drop("features")
        results.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
