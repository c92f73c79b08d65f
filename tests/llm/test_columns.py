"""Columns of the caller's table whose names operators use within."""

import brute
import pytest

from trigrove.llm import decontaminate, importance, language, lines, mixture, neardup, quality, secrets, sharding, toxicity, urls

ITEMS = [(1, "lost its id but has some words"), (2, "two words"), (3, "same text here")]


def _contamination(spark, docs, block_bytes):
    return decontaminate.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block_bytes)


def _labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "decontaminate": lambda spark, docs: _contamination(spark, docs, 1 << 20),
    "decontaminate in blocks": lambda spark, docs: _contamination(spark, docs, 30),
    "mixed": lambda spark, docs: mixture.mixed(docs),
    "curriculum": lambda spark, docs: mixture.curriculum(docs),
    "one_of_each": lambda spark, docs: neardup.one_of_each(docs),
    "quality": lambda spark, docs: quality.judged(docs, quality.trusted(_labels(spark))),
    "toxicity": lambda spark, docs: toxicity.scored(docs, _labels(spark)),
    "lines": lambda spark, docs: lines.without_boilerplate(docs, sites=2),
    "secrets": lambda spark, docs: secrets.scanned(docs),
    "language": lambda spark, docs: language.predicted(docs),
    "sharded": lambda spark, docs: sharding.sharded(docs),
    "urls": lambda spark, docs: urls.judged(docs, url="text"),
    "importance": lambda spark, docs: importance.resampled(docs, spark.createDataFrame(ITEMS, "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_keep_their_values(spark, name):
    docs = brute.table(spark, [r for r in brute.awkward() if r[0] is not None])
    assert brute.keeps_columns(OPERATORS[name](spark, docs))


def test_a_line_of_one_document_many_times(spark):
    """Removed lines at the front, at the end and side by side; what stays keeps its order."""
    rows = [(k, f"menu\nown {k}\nmenu\nfoot\nlast {k}\nfoot", "en", f"s{k}") for k in range(8)]
    found = {r["doc_id"]: r for r in lines.without_boilerplate(brute.table(spark, rows)).collect()}
    assert all(found[k]["clean_text"] == f"own {k}\nlast {k}" and found[k]["n_removed"] == 4 for k in range(8))
    long = "\n".join(f"line {k % 3} of {k}" if k % 2 else "menu" for k in range(20_000))
    one = lines.without_boilerplate(brute.table(spark, [*rows, (99, long, "en", "s1")])).where("doc_id = 99").first()
    assert one["n_removed"] == 10_000 and one["clean_text"] == "\n".join(f"line {k % 3} of {k}" for k in range(1, 20_000, 2))
