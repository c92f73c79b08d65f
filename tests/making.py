"""Small inputs for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigrove.model import CATALOG

NOW = 1_700_000_000


def entry(id, name, entry_type="File", path=None, tags=(), count=0, last=0, score=0.0, file_type=None, is_dir=False, category=None):
    return (id, entry_type, name, path or f"/home/{name}", None, score, last, count, (file_type, None, is_dir, list(tags), category), None, None)


def catalog(spark, *rows):
    return spark.createDataFrame(list(rows), CATALOG)


def queries(spark, *texts, **context):
    """One query per text; its number is the query id."""
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")
    return rows.withColumns({k: F.lit(v) for k, v in context.items()})


def found(results):
    """Entry ids by query id, in rank order."""
    ids = {}
    for row in results.orderBy("query_id", "rank").collect():
        ids.setdefault(row["query_id"], []).append(row["id"])
    return ids


def values(spark, **columns):
    """One row with the values of the given column expressions."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()
