"""Mixing sources to target weights by a curriculum whose weights change over training time.

Each source has a weight that moves linearly from a start to an end while training runs from 0 to 1. Its
integral is the source's share of all words; the cumulative demand of a source up to time t is its target
times ``t + ramp * (t * t - t)``. Documents of a source stand in a fixed random order; passing over them again
and again lays their copies on the axis of demanded words, and inverting the demand gives each copy its
training position. Copies are ordered by position with a range partitioning.

Targets stop at ``MOST_PASSES`` times a source's size and the excess goes to the others by weight. A copy is
taken if its middle lies before the target, so a source misses its target by half a document at most.

The order within a source is that of md5 of the id. Sums before a document come from sums of the ``BLOCKS``
blocks of that order and a window within a block, so a source with most of the rows is spread over tasks. All
in SQL functions; the sources themselves (rows of weights) pass through one task.

Defined results: null and empty texts have size 0, are taken as often as the passes reach them and add no
words; a null source is a source, the last; equal rows are documents of their own; no words at all gives
targets of 0 and takes nothing; a column of ``docs`` named like a made one gives way, any other keeps its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.llm.batches import named, others, packed, unpacked

#: (mean weight, ramp) of the sources in order of their names, again from the front after the last. A ramp of
#: -0.5 starts at 1.5 times the mean weight and ends at half of it.
CYCLE = ((5, -0.5), (2, 0.0), (1, 0.5))
MOST_PASSES = 3
BLOCK_DIGITS = 3
BLOCKS = 16**BLOCK_DIGITS
WORD = r"[^\x20\x09-\x0D]+"

MADE = ["size", "source_size", "target", "copies", "taken", "first_position"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, cycle=CYCLE) -> DataFrame:
    """``sizes`` (source, source_size) with weight, ramp and target: shares of all words, at most ``MOST_PASSES`` times the size.

    With sources in order of cap / weight those that stop at their cap come first; the level of the others
    is the largest that any cut between the two gives."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    pick = lambda i: F.element_at(F.array(*[F.lit(float(c[i])) for c in cycle]), (F.col("_place") + 1).cast("int"))
    weighed = sizes.withColumn("_place", place).withColumns({"weight": pick(0), "ramp": pick(1)}).drop("_place")
    capped = weighed.withColumn("_cap", F.col("source_size") * MOST_PASSES)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    level = (
        F.sum("source_size").over(all_rows)
        - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).cast("double") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = capped.withColumn("_level", level).withColumn("_level", F.max("_level").over(all_rows))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))
    return levelled.select("source", "source_size", "weight", "ramp", target.alias("target"))


def _position(words: Column, target: Column, ramp: Column) -> Column:
    """The time at which the demand reaches ``words``: the root of the quadratic, in the form that stands ramps of 0."""
    part = F.least(words / target, F.lit(1.0))
    flat = 1 - ramp
    return 2 * part / (flat + F.sqrt(flat * flat + 4 * ramp * part))


def _taken(docs: DataFrame, kept: list[str], doc_id: str, text: str, source: str, cycle) -> DataFrame:
    """``_doc`` (the kept columns), the made columns, and ``_start``, ``_ramp`` for the copies' positions."""
    shuffled = F.md5(F.coalesce(named(doc_id).cast("string"), F.lit("")))
    rows = docs.select(
        n_words(named(text).cast("string")).alias("size"), _key(named(source).cast("string")).alias("_source"),
        named(source).cast("string").alias("_name"), shuffled.alias("_order"), packed(kept),
    ).withColumn("_block", F.substring("_order", 1, BLOCK_DIGITS))
    by_block = rows.groupBy("_source", "_block").agg(F.sum("size").alias("_words"), F.max("_name").alias("source"))
    per_source = targets(by_block.groupBy("_source", "source").agg(F.sum("_words").alias("source_size")).select("source", "source_size"), cycle)
    per_source = per_source.select(_key(F.col("source")).alias("_source"), "source_size", "ramp", "target")
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = by_block.select("_source", "_block", before.alias("_before")).join(per_source, "_source")
    within = Window.partitionBy("_source", "_block").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(blocks, ["_source", "_block"])
    start = F.col("_before") + F.col("_within")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("_passes") * F.col("source_size")
    more = (F.col("source_size") > 0) & (F.col("_passes") < MOST_PASSES) & (2 * F.col("_start") + F.col("size") <= 2 * F.col("_rest"))
    taken = (
        placed.withColumns({"_start": start, "_passes": passes}).withColumn("_rest", rest)
        .withColumn("copies", F.col("_passes") + more.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumn("first_position", F.when(F.col("copies") > 0, _position(F.col("_start") + F.col("size") / 2, F.col("target"), F.col("ramp"))))
    )
    return taken.select("_doc", *MADE, "_start", F.col("ramp").alias("_ramp"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, cycle=CYCLE) -> DataFrame:
    """The kept columns of ``docs`` with ``size``, ``source_size``, ``target``, ``copies``, ``taken`` and ``first_position``
    (null if no copy is taken), one row per document. One shuffle of the kept columns."""
    kept = [c for c in others(docs, MADE) if keep is None or c in keep]
    return _taken(docs, kept, doc_id, text, source, cycle).select(*unpacked(kept), *MADE)


def curriculum(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", cycle=CYCLE) -> DataFrame:
    """The columns of ``docs``, a row for each taken copy, in order of training position (range partitions, sorted within)."""
    taken = _taken(docs, docs.columns, doc_id, text, source, cycle).where("copies > 0")
    copies = taken.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    middle = F.col("_pass") * F.col("source_size") + F.col("_start") + F.col("size") / 2
    placed = copies.select("_doc", F.col("_doc").getField(doc_id).alias("_id"), _position(middle, F.col("target"), F.col("_ramp")).alias("_position"))
    return placed.repartitionByRange("_position", "_id").sortWithinPartitions("_position", "_id").select(*unpacked(docs.columns))
