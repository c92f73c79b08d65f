"""Stored postings: the same results as tables worked out anew, before and after changes, and few rows read."""

import pytest
from making import catalog, entry
from pyspark.sql import functions as F

from trigrove.model import UNIX, WINDOWS
from trigrove.operators import index as X
from trigrove.plans import stored, tables, workload
from trigrove.plans.search import ranked_rows

NOW = 1_000_000


def rows_of(df):
    return sorted(map(repr, df.collect()))


def ranked(queries, found, profile):
    return rows_of(ranked_rows(queries, found, None, now=NOW, profile=profile.name).select("query_id", "rank", "id", "score"))


NAMES = ["Text Editor", "text editor", "Document Viewer", "documents.txt", "Music", "Display Settings", "Sound", "report.pdf", "Réport", "ab", ""]


def entries(first, n, kinds=("App", "File", "Setting", "Command")):
    made = []
    for k in range(first, first + n):
        name, kind = NAMES[k % len(NAMES)], kinds[k % len(kinds)]
        made.append(entry(k, name if k % 3 else f"{name} {k % 5}", kind, tags=["tool"] if k % 4 == 0 else [], file_type="txt" if kind == "File" and k % 2 else None))
    return made


@pytest.mark.parametrize("profile", [UNIX, WINDOWS])
def test_changes_give_the_tables_of_the_new_catalog(spark, tmp_path, profile):
    old = entries(1, 60)
    gone = [old[k] for k in (0, 3, 10, 11, 12, 44, 59)]
    come = entries(200, 9) + [entry(old[3][0], "moved.txt", file_type="txt")]
    left = [e for e in old if e not in gone] + come
    index = stored.StoredIndex.build(catalog(spark, *old), f"{tmp_path}/index", max_candidates=10, profile=profile, n_buckets=2)
    assert index.apply(catalog(spark, *gone), catalog(spark, *come)) == 1
    assert index.apply(catalog(spark, *left), catalog(spark), batch=1) == 1  # published already
    if profile is UNIX:
        index.apply(catalog(spark), catalog(spark, *entries(300, 4)))
        index.apply(catalog(spark, *entries(300, 4)), catalog(spark))
    now = catalog(spark, *left)
    found, wanted = index.tables(now), X.LookupTables.of(now, 10, profile)
    assert rows_of(found.gram_counts) == rows_of(wanted.gram_counts)
    assert rows_of(found.exact_terms) == rows_of(wanted.exact_terms)
    for words in ("app_terms", "setting_words", "extensions"):
        assert rows_of(getattr(found, words)) == rows_of(getattr(wanted, words))
    held = wanted.shapes.select("entry_class", F.explode("grams").alias("gram"), "shape_id", "grams")
    assert rows_of(found.posting_rows().select(*held.columns)) == rows_of(held)
    asked = [("a", "txt editor"), ("b", "tool"), ("c", "display"), ("d", "report.txt"), ("e", " "), ("f", "reprt")]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    assert ranked(queries, found, profile) == ranked(queries, wanted, profile)
    if profile is WINDOWS:
        return
    many = spark.createDataFrame([(str(k), f"text editor {k}") for k in range(100)], queries.schema)
    assert ranked(many, found, profile) == ranked(many, wanted, profile)


def test_a_query_reads_few_postings(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "PAGE_ROWS", 20)
    index = stored.StoredIndex.build(tables.catalog(spark, data), f"{tmp_path}/index", n_buckets=4)
    found = index.tables(tables.catalog(spark, data))
    asked = [("App", "sma"), ("App", "wid"), ("File", "mal")]
    few = found.postings.where(stored._any_of(asked, "gram")).select("entry_class", "gram", "shape_id")
    few.collect()
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().get("numOutputRows").get().value()
    assert 0 < read < found.postings.count() / 10
