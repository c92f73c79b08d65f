"""Lookup tables on disk that follow their catalog.

Every table is a sum of signed rows. ``build`` writes the rows of a whole catalog as batch 0; ``apply`` writes what a batch of
changes takes away (-1) and adds (+1), nothing else, and names the batch as published when all of it is there. A search reads
the batches published when it begins, so one that runs meanwhile is not disturbed, and a batch that is written again
replaces its own rows only.

* ``entries``: all entries, by a hash of class and terms (``bucket``). From here the shapes that a batch touches are made anew.
* ``shapes``: terms and members of each shape, by the same bucket.
* ``postings``: for each gram the shapes that hold it, with all their grams, sorted by class and gram, so that a search for a few grams reads few
  pages. What is stored is about as many times the grams as a shape has of them; in exchange a meeting is graded where it is read.
* ``counts``, ``owners``, ``words``: entries and shapes of each gram, who owns an exact term, the words of the intents.

``build`` into a new folder every now and then keeps the number of batches small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import text
from trigrove.model import Profile, UNIX
from trigrove.operators import index as X
from trigrove.plans.shared import written

BUCKETS = 64
MOST_SEARCHES = 64
MOST_LITERALS = 256

TABLES = ("entries", "shapes", "postings", "counts", "owners", "words")
SHAPE = ["entry_class", "terms"]
PAGE_ROWS = 500
ROW_GROUP_BYTES = 16 << 20


def bucket_of(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("entry_class", F.array_join("terms", "\0")), F.lit(n_buckets)).cast("int")


def signed_difference(old: DataFrame, new: DataFrame, *numbers: str) -> DataFrame:
    """``new`` minus ``old``: their rows with the sums of ``numbers`` (of a sign without any), none that are all 0."""
    sums = numbers or ("sign",)
    if not numbers:
        old, new = old.withColumn("sign", F.lit(1)), new.withColumn("sign", F.lit(1))
    keys = [c for c in new.columns if c not in sums]
    both = new.unionByName(old.withColumns({c: -F.col(c) for c in sums}))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in sums]))


def net(rows: DataFrame, keys: Sequence[str], number: str = "sign") -> DataFrame:
    """Rows that are left when all batches are added up."""
    return rows.groupBy(*keys).agg(F.sum(number).alias(number)).where(F.col(number) > 0)


def shape_rows(entries: DataFrame, most: int) -> DataFrame:
    """Shapes of entries with their last owner in catalog order."""
    owner = F.struct("id", "name", "access_count", "last_accessed", "frecency_score", "terms")
    last = entries.groupBy(*SHAPE).agg(F.max_by(F.struct(F.col("position"), owner.alias("owner")), "position").alias("last"))
    return X.shapes(entries, most).join(last, SHAPE)


def vocabulary(catalog: DataFrame, trimmed: bool) -> DataFrame:
    """How many entries have each word of the three vocabularies: ``(kind, word, n)``."""
    terms = text.lower_terms(F.col("name"), F.col("metadata.tags"))
    if trimmed:
        terms = F.transform(terms, text.trim_space)
    kind = F.lower(F.regexp_replace("metadata.file_type", r"^\.+", ""))
    words = (
        F.when(F.col("entry_type") == "App", F.transform(F.array_distinct(terms), lambda w: F.struct(F.lit("app").alias("kind"), w.alias("word"))))
        .when(F.col("entry_type") == "Setting", F.transform(F.array_distinct(F.split(F.lower("name"), r"(?U)\s+")), lambda w: F.struct(F.lit("setting").alias("kind"), w.alias("word"))))
        .when((F.col("entry_type") == "File") & kind.isNotNull(), F.array(F.struct(F.lit("file").alias("kind"), kind.alias("word"))))
    )
    return catalog.select(F.explode(words).alias("w")).select("w.*").where("kind <> 'setting' or word <> ''").groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))


def _any_of(pairs: Sequence[tuple[str, str]], second: str) -> Column:
    """The rows of these (class, value) pairs, in a form that reaches the file statistics."""
    tests = [(F.col("entry_class") == c) & (F.col(second) == v) for c, v in pairs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass
class StoredTables(X.LookupTables):
    """Lookup tables as a search reads them from the stored rows."""

    postings: DataFrame | None = None
    counts: DataFrame | None = None
    few: bool = False

    def for_searches(self, searches: DataFrame) -> StoredTables:
        """The tables for some searches. If these are few, only the counts of their grams are read."""
        some = searches.select("entry_class", "search_text").limit(MOST_SEARCHES + 1)
        cut = some.groupBy().agg(F.count(F.lit(1)).alias("n"), F.collect_set("entry_class").alias("classes"), F.flatten(F.collect_set(text.trigrams(F.col("search_text")))).alias("grams"))
        seen = cut.first()  # of MOST_SEARCHES texts and one more
        if seen["n"] > MOST_SEARCHES:
            return self
        asked = F.col("entry_class").isin(seen["classes"]) & F.col("gram").isin(sorted(set(seen["grams"])))
        return replace(self, gram_counts=_gram_counts(self.counts.where(asked)), few=True)

    def looked_up(self, lookups: DataFrame) -> tuple[StoredTables, DataFrame]:
        """Of few searches the lookups are taken to the driver, and of the postings the pages of their grams are read only."""
        if not self.few:
            return self, lookups
        rows = lookups.collect()  # the grams of MOST_SEARCHES texts at most
        pairs = sorted({(r["entry_class"], r["gram"]) for r in rows})
        held = lookups.sparkSession.createDataFrame(rows, lookups.schema)
        return (replace(self, postings=self.postings.where(_any_of(pairs, "gram"))) if len(pairs) <= MOST_LITERALS else self), held

    def posting_rows(self) -> DataFrame:
        return net(self.postings, ["entry_class", "gram", "shape_id", "bucket", "grams"]).drop("sign")

    def members(self, best: DataFrame) -> DataFrame:
        """``best`` with terms and members of its shapes, which are read from their buckets."""
        keys = ["entry_class", "bucket", "shape_id"]
        live = net(self.shapes.join(best.select(*keys).distinct(), keys), [*keys, "terms", "members"]).drop("sign")
        return best.join(live, keys)


def _gram_counts(signed: DataFrame) -> DataFrame:
    return signed.groupBy("entry_class", "gram").agg(F.sum("entries").alias("entries"), F.sum("n_shapes").alias("n_shapes")).where("entries > 0")


class StoredIndex:
    """The stored tables of one catalog; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = spark.read.json(f"{self.folder}/about").first()
        self.most, self.profile, self.n_buckets = about["most"], about["profile"], about["n_buckets"]
        self.trimmed = about["trimmed"]

    @classmethod
    def build(cls, catalog: DataFrame, folder: str, *, max_candidates: int = 100, profile: Profile = UNIX, n_buckets: int = BUCKETS) -> StoredIndex:
        spark = catalog.sparkSession
        about = spark.createDataFrame(
            [(profile.max_candidates(max_candidates), profile.name, n_buckets, profile.trim_app_terms)], "most int, profile string, n_buckets int, trimmed boolean")
        about.coalesce(1).write.mode("overwrite").json(f"{folder}/about")
        made = cls(spark, folder)
        made._write(0, X.entry_terms(catalog.limit(0)), X.entry_terms(catalog), catalog.limit(0), catalog)
        return made

    def published(self) -> int:
        """The last batch that is all there."""
        try:
            return self.spark.read.schema("batch long").json(f"{self.folder}/published").agg(F.max("batch")).first()[0]
        except AnalysisException:
            return -1

    def _read(self, table: str, until: int) -> DataFrame:
        places = [f"{self.folder}/{table}/batch={n}" for n in range(until + 1)]
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*places).drop("batch")

    def apply(self, removed: DataFrame, added: DataFrame, batch: int | None = None) -> int:
        """Follow a change of the catalog: ``removed`` are rows that it held, ``added`` those that it holds instead; a changed
        row is in both. Reads the buckets that these touch. A ``batch`` published already is left as it is."""
        last = self.published()
        if batch is not None and batch <= last:
            return batch
        removed, added = written(removed, "removed"), written(added, "added")
        gone, come = (written(X.entry_terms(rows).withColumn("bucket", bucket_of(self.n_buckets)), "changed") for rows in (removed, added))
        keys = gone.select(*SHAPE, "bucket").unionByName(come.select(*SHAPE, "bucket")).distinct()
        touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # n_buckets at most
        stored = self._read("entries", last).where(F.col("bucket").isin(touched)).join(keys, [*SHAPE, "bucket"], "left_semi")
        values = [c for c in stored.columns if c not in ("sign", "bucket")]
        old = written(net(stored, values).select(*values), "entries")
        signed = old.withColumn("sign", F.lit(1)).unionByName(gone.select(*values, F.lit(-1).alias("sign"))).unionByName(come.select(*values, F.lit(1).alias("sign")))
        new = written(net(signed, values).select(*values), "entries")
        self._write(last + 1, old, new, removed, added)
        return last + 1

    def _write(self, batch: int, old: DataFrame, new: DataFrame, removed: DataFrame, added: DataFrame) -> None:
        """Signed rows of a batch from the entries of its shapes before and after it and from its catalog rows."""
        place = lambda table: f"{self.folder}/{table}/batch={batch}"
        spread = max(self.spark.sparkContext.defaultParallelism, 1)

        def keep(table: str, rows: DataFrame, by: str | None = None, order: Sequence[str] = ()) -> None:
            if order:
                rows = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order)
            writer = rows.write.mode("overwrite").options(**{"parquet.page.row.count.limit": PAGE_ROWS, "parquet.block.size": ROW_GROUP_BYTES})
            (writer.partitionBy(by) if by else writer).parquet(place(table))

        by_bucket = lambda rows: rows.withColumn("bucket", bucket_of(self.n_buckets)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        keep("entries", by_bucket(signed_difference(old, new)), "bucket")
        before, after = (shape_rows(e, self.most) for e in (old, new))
        shapes = written(signed_difference(before, after).withColumn("bucket", bucket_of(self.n_buckets)), "shapes")
        keep("shapes", shapes.select("entry_class", "bucket", "shape_id", "terms", "members", "sign").repartition("bucket"), "bucket")
        held = shapes.groupBy("entry_class", "shape_id", "bucket", "grams").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        keep("postings", X.postings(held, "bucket", "grams", "sign").select("entry_class", "gram", "shape_id", "bucket", "grams", "sign"), order=("entry_class", "gram", "shape_id"))
        sums = X.postings(shapes, "n_entries", "sign").groupBy("entry_class", "gram").agg(F.sum(F.col("n_entries") * F.col("sign")).alias("entries"), F.sum("sign").alias("n_shapes"))
        keep("counts", sums.where("entries <> 0 or n_shapes <> 0"), order=("entry_class", "gram"))
        spelled = shapes.select("entry_class", "last", "sign", F.explode(F.array_distinct(F.transform("terms", text.trim_space))).alias("term")).where("term <> ''")
        owners = spelled.groupBy("entry_class", "term", "last").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        keep("owners", owners.select("entry_class", "term", "last.position", "last.owner", "sign"), order=("entry_class", "term"))
        words = signed_difference(vocabulary(removed, self.trimmed), vocabulary(added, self.trimmed), "n")
        keep("words", words, order=("kind", "word"))
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").json(f"{self.folder}/published")

    def tables(self, catalog: DataFrame) -> StoredTables:
        """The lookup tables of the batches published now; ``catalog`` is the catalog that they follow."""
        last = self.published()
        read = {t: self._read(t, last) for t in TABLES if t != "entries"}
        owners = net(read["owners"], ["entry_class", "term", "position", "owner"]).groupBy("entry_class", "term").agg(F.max_by("owner", "position").alias("owner"))
        words = net(read["words"], ["kind", "word"], "n")
        return StoredTables(
            catalog=catalog, shapes=read["shapes"], gram_counts=_gram_counts(read["counts"]), exact_terms=owners,
            app_terms=words.where("kind = 'app'").select(F.col("word").alias("term")), setting_words=words.where("kind = 'setting'").select("word"),
            extensions=words.where("kind = 'file'").select(F.col("word").alias("extension")), max_candidates=self.most, profile=self.profile,
            postings=read["postings"], counts=read["counts"],
        )
