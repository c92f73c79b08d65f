"""A uniform shuffle of documents into shards whose sizes are exact, by a hypergeometric communication matrix.

Documents are dealt by a hash into parts. How many rows of each part go to each cell (a block of slots of a
shard) is drawn first: splitting the parts in halves again and again, the rows of a half that go to a cell are
hypergeometric given the rows of the half, the size of the cell and all rows, one cell after another. Each part
is then put in random order and cut by its row of the matrix, the pieces are exchanged, and each cell is put in
random order again. Row counts of shards differ by one at most. All in SQL functions.

Random numbers are hashes of the seed, so a task that runs again, after its executor was lost, draws the same.
The matrix has ``MOST_CELLS`` columns and as many rows at most; it is the only thing that passes through few tasks.

Defined results: null ids and texts are values like others; equal rows are rows of their own and may change
places; an empty table gives no rows; a column of ``docs`` named like a made one gives way, any other keeps its value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigrove.llm.batches import named, others, packed, unpacked

SHARDS = 16
ROWS_PER_CELL = 1 << 12
MOST_CELLS = 1024
SEED = 20


def _let(values: dict[str, Column], body) -> Column:
    """``body`` over a struct of values that are computed once."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body)[0]


def _long(x: Column) -> Column:
    return x.cast("long")


def hypergeometric(total: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``good`` among ``total`` are met in ``draws`` draws, for a uniform number.

    Weights relative to the most likely value are summed upwards and downwards from it, and the number
    falls on one of them. Weights more than twelve deviations away are below the precision of a double."""

    def bounds(v):
        likely = F.floor((v["n"] + 1).cast("double") * (v["k"] + 1) / (v["t"] + 2))
        part = v["k"] / F.greatest(v["t"], F.lit(1)).cast("double")
        spread = F.sqrt(v["n"] * part * (1 - part) * (v["t"] - v["n"]) / F.greatest(v["t"] - 1, F.lit(1)))
        low = F.greatest(F.lit(0).cast("long"), v["n"] - (v["t"] - v["k"]))
        high = F.least(v["n"], v["k"])
        mode = F.greatest(low, F.least(high, _long(likely)))
        reach = _long(F.ceil(12 * spread)) + 12
        return {"t": v["t"], "k": v["k"], "n": v["n"], "u": v["u"], "mode": mode, "low": F.greatest(low, mode - reach), "high": F.least(high, mode + reach)}

    def up(b, x):
        """From the weight of x - 1 to that of x."""
        return (b["k"] - x + 1).cast("double") * (b["n"] - x + 1) / (x.cast("double") * (b["t"] - b["k"] - b["n"] + x))

    def down(b, x):
        """From the weight of x + 1 to that of x."""
        return (x + 1).cast("double") * (b["t"] - b["k"] - b["n"] + x + 1) / ((b["k"] - x).cast("double") * (b["n"] - x))

    def walk(b, values, step, target):
        """Weights added up over ``values``; the first value at which they exceed ``target``."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"))
        return F.aggregate(
            values, start,
            lambda a, x: _let(
                {"w": F.when(x == b["mode"], 1.0).otherwise(a["w"] * step(b, x)), "sum": a["sum"], "at": a["at"], "x": x},
                lambda s: F.struct(
                    s["w"].alias("w"), (s["sum"] + s["w"]).alias("sum"),
                    F.coalesce(s["at"], F.when(s["sum"] + s["w"] > target, s["x"])).alias("at"),
                ),
            ),
        )

    def drawn(b):
        rising = F.sequence(b["mode"], b["high"])
        falling = F.when(b["low"] < b["mode"], F.sequence(b["mode"] - 1, b["low"], F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        sums = {
            **{n: b[n] for n in ("t", "k", "n", "u", "mode", "low", "high")}, "rising": rising, "falling": falling,
            "above": walk(b, rising, up, F.lit(math.inf))["sum"], "below": walk(b, falling, down, F.lit(math.inf))["sum"],
        }

        def chosen(s):
            target = s["u"] * (s["above"] + s["below"])
            upward = F.coalesce(walk(s, s["rising"], up, target)["at"], s["high"])
            downward = F.coalesce(walk(s, s["falling"], down, target - s["above"])["at"], s["low"])
            return F.when(target < s["above"], upward).otherwise(downward)

        return _let(sums, chosen)

    first = {"t": _long(total), "k": _long(good), "n": _long(draws), "u": uniform}
    return _let(first, lambda v: _let(bounds(v), drawn))


def _uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def _left_draw(cells: Column, n_left: Column, n_all: Column, node: Column, seed: int) -> Column:
    """Rows of the left half that go to each cell: one hypergeometric number after another."""
    start = F.struct(F.array().cast("array<long>").alias("drawn"), _long(n_all).alias("total"), _long(n_left).alias("need"))

    def step(a, cell):
        u = _uniform(F.lit(seed), node, F.size(a["drawn"]))
        return _let(
            {"x": hypergeometric(a["total"], cell, a["need"], u), "a": a, "cell": cell},
            lambda s: F.struct(
                F.concat(s["a"]["drawn"], F.array(s["x"])).alias("drawn"), (s["a"]["total"] - s["cell"]).alias("total"),
                (s["a"]["need"] - s["x"]).alias("need"),
            ),
        )

    return F.aggregate(cells, start, step)["drawn"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def matrix(part_counts: DataFrame, parts: int, cells: list[int], seed: int = SEED) -> DataFrame:
    """(part, row): for each part how many of its rows go to each cell. ``part_counts`` is (part, n); ``parts`` a power of two."""
    spark = part_counts.sparkSession
    every = spark.range(parts).select(F.col("id").alias("part"))
    counted = every.join(part_counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda s: s["n"])  # ``parts`` numbers
    nodes = counted.agg(ordered.alias("counts")).select(
        F.lit(1).cast("long").alias("node"), "counts", F.array(*[F.lit(c).cast("long") for c in cells]).alias("row")
    )
    for depth in range(parts.bit_length() - 1):
        half = parts >> (depth + 1)
        halves = nodes.withColumns({"left": F.slice("counts", 1, half), "right": F.slice("counts", half + 1, half)})
        drawn = halves.withColumn("drawn", _left_draw(F.col("row"), _total(F.col("left")), _total(F.col("counts")), F.col("node"), seed))
        split = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("counts"), F.col("drawn").alias("row")),
            F.struct(
                (2 * F.col("node") + 1).alias("node"), F.col("right").alias("counts"),
                F.zip_with("row", "drawn", lambda a, b: a - b).alias("row"),
            ),
        )
        nodes = drawn.select(F.inline(split))
        if depth in (4, 7):
            nodes = nodes.repartition(1 << (depth - 1), "node")
    return nodes.select((F.col("node") - parts).alias("part"), "row")


def layout(n: int, shards: int = SHARDS, rows_per_cell: int = ROWS_PER_CELL) -> tuple[int, list[int]]:
    """The number of parts and the cell sizes for ``n`` rows: shards of n / shards rows, give or take one, each cut into equally many cells."""
    per_shard = 1
    while per_shard * shards * rows_per_cell < n and per_shard * shards < MOST_CELLS:
        per_shard *= 2
    parts = 1
    while parts < per_shard * shards:
        parts *= 2
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    return parts, [z * (j + 1) // per_shard - z * j // per_shard for z in sizes for j in range(per_shard)]


def sharded(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, keep: list[str] | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """The kept columns of ``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``. Two exchanges of the kept columns."""
    made = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in others(docs, made) if keep is None or c in keep]
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    mark = F.xxhash64(F.lit(seed), named(doc_id).cast("string"), named(text).cast("string"))
    n = docs.count()
    parts, cells = layout(n, shards, rows_per_cell)
    marked = docs.select(mark.alias("_mark"))
    part = F.pmod(F.col("_mark"), F.lit(parts)).alias("_part")
    counts = marked.groupBy(part).count().select(F.col("_part").alias("part"), F.col("count").alias("n"))
    ends = F.aggregate("row", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(x + F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(0))))
    per_shard = len(cells) // shards
    firsts = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.element_at("_ends", (s * per_shard).cast("int")))
    cuts = matrix(counts, parts, cells, seed).select(F.col("part").alias("_part"), ends.alias("_ends")).withColumn("_shard_ends", firsts)
    rows = docs.select(
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), mark.alias("_mark"), packed(kept)
    ).withColumn("_part", F.pmod(F.col("_mark"), F.lit(parts)))
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), "_mark"), "_mark")
    ranked = rows.withColumn("_rank", F.row_number().over(local) - 1).join(cuts, "_part")
    shard = F.size(F.filter("_shard_ends", lambda e: e <= F.col("_rank")))
    block = F.size(F.filter(F.slice("_ends", F.col("shard") * per_shard + 1, per_shard), lambda e: e <= F.col("_rank")))
    sent = ranked.withColumn("shard", shard).withColumn("_cell", F.col("shard") * per_shard + block).drop("_ends", "_shard_ends", "_part")
    offsets, at = [], 0
    for i, size in enumerate(cells):
        at = 0 if i % per_shard == 0 else at
        offsets.append(at)
        at += size
    again = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 2), "_mark"), "_mark")
    offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_cell") + 1)
    return sent.withColumn("slot", F.row_number().over(again) - 1 + offset).select(*unpacked(kept), *made)
