"""A catalog on disk in the order of its paths, which follows changes by reading and writing only where they lie.

Everything at or below a path ``p`` has a key from ``p`` up to, but without, ``p0`` ("0" follows "/"). Files are sorted by key in
small pages, so such an interval is read from the pages that it meets. A batch of any size becomes at most ``MOST_RANGES`` such
intervals: neighbouring ones are joined, which may read rows between them but leaves none out. The exact rules are
applied to what was read, and only the difference is written, as signed rows (-1 gone, +1 come).

* ``rows``: the catalog rows of each batch, in the order of keys. ``read`` adds the batches up.
* ``ids``: (id, key), in the order of ids, to find rows that a change replaces by their id and not by their path.

``build`` into a new folder every now and then keeps the number of batches small. One writer at a time; ids are unique.
Rows without a path have the empty key: no change of a path meets them, one with their id does. Places in catalog order
are written out: the id for a row without position, generation 0 for one without.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import paths
from trigrove.model import Profile, UNIX, WINDOWS
from trigrove.operators import catalog as K
from trigrove.plans.shared import written
from trigrove.plans.stored import net, signed_difference

MOST_RANGES = 256
ROWS_PER_FILE = 1_000_000
PAGE_ROWS = 500
ROW_GROUP_BYTES = 16 << 20
PUBLISHED = "batch long, generation long, feed string, feed_batch long"


def sort_key(profile: Profile) -> Column:
    return F.coalesce(K.path_key("path", profile), F.lit(""))


def subtree_range(key: Column) -> list[Column]:
    """(low, high): the keys at or below ``key`` and few others. Below "/" lies every path that begins with it, and the empty one."""
    root = key == "/"
    return [F.when(root, "").otherwise(key).alias("low"), F.when(root, "0").otherwise(F.concat(key, F.lit("0"))).alias("high")]


def covering(ranges: DataFrame, most: int = MOST_RANGES) -> list[tuple]:
    """At most ``most`` intervals that hold all of ``ranges`` (low, high), with overlapping ones merged."""
    part = F.spark_partition_id().alias("part")
    parts = ranges.distinct().repartitionByRange(most, "low").select("low", "high", part)
    found = parts.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("low").collect()  # ``most`` rows
    merged: list[tuple] = []
    for row in found:
        if merged and row["low"] <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], row["high"]))
        else:
            merged.append((row["low"], row["high"]))
    return merged


def inside(column: str, ranges: list[tuple]) -> Column:
    """Rows in one of the intervals, in a form that reaches the statistics of files and pages."""
    return reduce(lambda a, b: a | b, [(F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)) for low, high in ranges], F.lit(False))


class PathedCatalog:
    """The stored catalog in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        name = spark.read.json(f"{self.folder}/about").first()["profile"]
        self.profile = WINDOWS if name == "windows" else UNIX

    @classmethod
    def build(cls, catalog: DataFrame, folder: str, *, profile: Profile = UNIX, rows_per_file: int = ROWS_PER_FILE) -> PathedCatalog:
        spark = catalog.sparkSession
        spark.createDataFrame([(profile.name,)], "profile string").coalesce(1).write.mode("overwrite").json(f"{folder}/about")
        made = cls(spark, folder)
        placed = K.as_catalog(catalog).withColumns({"position": F.coalesce("position", "id"), "generation": F.coalesce("generation", F.lit(0).cast("long")), "sign": F.lit(1).cast("long")})
        made._write(0, written(placed, "catalog"), None, None, None, rows_per_file)
        return made

    def _published(self) -> DataFrame:
        return self.spark.read.schema(PUBLISHED).json(f"{self.folder}/published")

    def published(self) -> tuple[int, int]:
        """The last batch that is all there, and the latest generation of its rows."""
        try:
            last = self._published().agg(F.max("batch").alias("batch"), F.max("generation").alias("generation")).first()
        except AnalysisException:
            return -1, 0
        return last["batch"], last["generation"]

    def applied(self, feed: str, feed_batch: int) -> bool:
        return not self._published().where((F.col("feed") == feed) & (F.col("feed_batch") == feed_batch)).isEmpty()

    def _table(self, table: str, until: int) -> DataFrame:
        places = [f"{self.folder}/{table}/batch={n}" for n in range(until + 1)]
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*places).drop("batch")

    def _within(self, ranges: list[tuple], until: int) -> DataFrame:
        return net(self._table("rows", until).where(inside("key", ranges)), ["key", *K.COLUMNS]).drop("sign")

    def read(self) -> DataFrame:
        """The catalog of the batches published now."""
        return net(self._table("rows", self.published()[0]), K.COLUMNS).drop("sign")

    def below(self, above: DataFrame) -> DataFrame:
        """Entries at or below the paths ``above`` (``path``), from the pages where these lie. Each is there once."""
        gone = written(K.distinct_roots(above.where("path is not null").select(K.path_key("path", self.profile).alias("path"))), "roots")
        some = self._within(covering(gone.select(*subtree_range(F.col("path")))), self.published()[0])
        over = some.select("id", F.explode(paths.ancestors(F.col("key"))).alias("path")).join(gone, "path").select("id").distinct()
        return some.join(over, "id", "left_semi").where("path is not null").select(*K.COLUMNS)

    def _keys_of(self, ids: DataFrame, until: int) -> DataFrame:
        """Where rows with these ids lie or lay. Few ids are looked up in the pages of their intervals, many read the two columns."""
        known = self._table("ids", until)
        ranges = covering(ids.select(F.col("id").alias("low"), F.col("id").alias("high")))
        near = reduce(lambda a, b: a | b, [F.col("id").between(low, high) for low, high in ranges], F.lit(False))
        return known.where(near).join(ids, "id", "left_semi").select("key").distinct()

    def apply(
        self, changes: DataFrame, *, listing: DataFrame | None = None, desktop_files: DataFrame | None = None,
        feed: str | None = None, feed_batch: int | None = None,
    ) -> int:
        """Follow a batch of changes by the rules of ``apply_changes``; the number of the batch written. A batch of a feed that is
        there already changes nothing."""
        last, generation = self.published()
        if feed is not None and self.applied(feed, feed_batch):
            return last
        changes = written(changes, "changes")
        come = written(K.changed_rows(changes, listing=listing, desktop_files=desktop_files, profile=self.profile), "come")
        ids = written(come.select("id").unionByName(K.made_from(changes, self.profile)).distinct(), "ids")
        subtrees = changes.where("path is not null").select(*subtree_range(K.path_key("path", self.profile)))
        alone = self._keys_of(ids, last).select(F.col("key").alias("low"), F.concat("key", F.lit("\x01")).alias("high"))
        old = written(self._within(covering(subtrees.unionByName(alone)), last).select(*K.COLUMNS), "old")
        new = written(K.merge_last(K.without_changed(old, changes, self.profile), come, generation), "new")
        self._write(last + 1, written(signed_difference(old, new), "signed"), generation, feed, feed_batch)
        return last + 1

    def _write(self, batch: int, signed: DataFrame, generation: int | None, feed: str | None, feed_batch: int | None, rows_per_file: int = ROWS_PER_FILE) -> None:
        about = signed.agg(F.count("*").alias("n"), F.max(F.coalesce("generation", F.lit(0))).alias("last")).first()
        n_files = max(1, -(-about["n"] // rows_per_file))
        keyed = signed.withColumn("key", sort_key(self.profile))

        def keep(table: str, rows: DataFrame, *order: str) -> None:
            ordered = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order)
            sizes = {"parquet.page.row.count.limit": PAGE_ROWS, "parquet.block.size": ROW_GROUP_BYTES}
            ordered.write.mode("overwrite").options(**sizes).parquet(f"{self.folder}/{table}/batch={batch}")

        keep("rows", keyed, "key", "id")
        keep("ids", keyed.where("sign > 0").select("id", "key"), "id", "key")
        latest = max(generation or 0, about["last"] or 0)
        published = self.spark.createDataFrame([(batch, latest, feed, feed_batch)], PUBLISHED)
        published.coalesce(1).write.mode("append").json(f"{self.folder}/published")
