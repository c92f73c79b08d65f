"""Line dedup: lines that stand on many different sites are boilerplate and removed wherever they stand.

Every line's hash gets a HyperLogLog sketch of its sites, and sketches merge by aggregation, partly before the
shuffle. A line whose estimate is far above the threshold is boilerplate, one far below, or with fewer rows than the
threshold, is not; the lines between get an exact count of distinct sites. All in SQL functions.

The removed positions of each document, and no other lines, are brought together and joined with the documents: the
texts are shuffled once.

Lines are compared without spaces around them; blank lines are neither counted nor removed. Defined results: a null
text has no lines and stays null; a null site is one site; a line that a text repeats is removed at each place; an
empty table gives no rows; equal rows get equal results; a column of ``docs`` named like a made one gives way, any other keeps its value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.batches import named, others, packed, unpacked

SITES = 5
#: Estimates within this factor of the threshold are counted exactly. 64 registers err by 13 %, at such small counts by less.
BAND = 2.5
RELATIVE_ERROR = 0.14

#: Rows of one line are split by their document over this many tasks when removed lines are looked up.
SPLITS = 16

MADE = ["n_lines", "n_removed", "clean_text"]


def _mark(doc_id: str, text: str):
    return F.xxhash64(named(doc_id).cast("string"), named(text).cast("string"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line) of the hashes in ``lines`` (line, site) that stand on ``sites`` different sites or more."""
    spread = lines.groupBy("line").agg(F.count("*").alias("n"), F.approx_count_distinct("site", RELATIVE_ERROR).alias("estimate")).where(F.col("n") >= sites)
    sure = spread.where(F.col("estimate") > sites * BAND).select("line")
    near = spread.where(F.col("estimate").between(sites / BAND, sites * BAND)).select("line")
    exact = lines.distinct().join(near, "line").groupBy("line").count().where(F.col("count") >= sites)
    return sure.union(exact.select("line"))


def without_boilerplate(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, keep: list[str] | None = None
) -> DataFrame:
    """The kept columns of ``docs`` with ``n_lines``, ``n_removed`` and ``clean_text``."""
    kept = [c for c in others(docs, MADE) if keep is None or c in keep]
    cut = F.split(named(text).cast("string"), "\n", -1)
    stood = F.when(named(site).isNull(), "-").otherwise(F.concat(F.lit("="), named(site).cast("string")))
    lines = (
        docs.select(_mark(doc_id, text).alias("mark"), stood.alias("site"), F.posexplode(cut).alias("position", "line"))
        .withColumn("line", F.trim("line")).where("line <> ''").withColumn("line", F.xxhash64("line"))
    )
    spread = boilerplate(lines.select("line", "site"), sites).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    found = lines.withColumn("split", F.pmod("mark", F.lit(SPLITS)).cast("int")).join(spread, ["line", "split"])
    removed = found.groupBy("mark").agg(F.array_sort(F.collect_set("position")).alias("_removed"))
    rows = docs.select(_mark(doc_id, text).alias("mark"), packed(kept), named(text).cast("string").alias("_text"))
    both = rows.join(removed, "mark", "left").withColumn("_lines", F.split("_text", "\n", -1))
    n_lines = F.coalesce(F.size(F.filter("_lines", lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    starts = F.concat(F.array(F.lit(0)), F.transform("_removed", lambda p: p + 1))
    ends = F.concat("_removed", F.array(F.size("_lines")))
    between = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("_lines", s + 1, e - s)))
    clean = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(F.array_join(between, "\n"))
    n_removed = F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long")
    return both.select(
        *unpacked(kept), F.when(F.col("_text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"), n_removed.alias("n_removed"),
        clean.alias("clean_text"),
    )
