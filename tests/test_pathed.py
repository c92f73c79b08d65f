"""A catalog in the order of its paths: the same rows as changes of the whole catalog give, and few rows read."""

import pytest
from making import catalog, entry
from pyspark.sql import functions as F

from trigrove.functions import paths
from trigrove.model import UNIX, WINDOWS
from trigrove.operators import catalog as K
from trigrove.plans import pathed
from trigrove.streaming.changes import stream_changes_by_path

CHANGE = "seq long, kind string, path string, is_dir boolean, size long"
PATHS = ["/a", "/a/b", "/a/b/c.txt", "/a/b!", "/a/b!/x", "/a/b-2/y.txt", "/a/b0", "/a/b0/z", "/a//d/", "/B/c", "/b/c", "", "/", "rel/x", "rel", "/a/é/ü.txt", "/a/b/c.txt/below"]


def rows_of(df):
    return sorted(map(repr, df.withColumn("position", F.coalesce("position", "id")).drop("generation").collect()))


def base(spark, profile):
    made = [entry(k + 1, f"n{k}", path=path, count=k) for k, path in enumerate(PATHS) if path]
    made += [(90, "File", "empty", "", None, 0.0, 0, 0, None, None, None), (91, "App", "no path", None, None, 0.0, 0, 0, None, None, None)]
    made += [(92, "App", "below", "/a/b/app", None, 0.0, 0, 0, None, 3, 2)]
    files = catalog(spark, *made)
    source = spark.createDataFrame([("/apps/code.desktop",), ("/apps/old.desktop",)], "path string")
    made_from = source.select(paths.stable_id(F.lit("App"), F.col("path"), profile.caseless_paths).alias("id"), F.lit("App").alias("entry_type"), F.lit("Code").alias("name"), F.lit("code").alias("path"))
    return K.as_catalog(files).unionByName(K.as_catalog(made_from))


BATCHES = [
    [(1, "Removed", "/a/b", True, None)],
    [(1, "Created", "/a/b", True, None), (2, "Modified", "/a/b!/x", False, 7), (3, "Removed", "/B", True, None)],
    [(1, "Created", "/apps/code.desktop", False, 1), (2, "Removed", "/apps/old.desktop", False, None), (3, "Created", "/new/f.txt", False, 5), (4, "Created", "/new/f.txt", False, 6)],
    [(1, "Modified", "/apps/code.desktop", False, 1), (2, "Modified", None, False, 1), (3, "Created", "rel", True, None)],
    [(1, "Created", "/a/b/c.txt", False, 9), (2, "Removed", "/a/b", True, None), (3, "Created", "/a/b/k.txt", False, 4)],
    [],
    [(1, "Removed", "/", True, None)],
]


@pytest.mark.parametrize("profile", [UNIX, WINDOWS])
def test_batches_give_the_changed_catalog(spark, tmp_path, profile, monkeypatch):
    monkeypatch.setattr(pathed, "MOST_RANGES", 8)
    whole = base(spark, profile)
    store = pathed.PathedCatalog.build(whole, f"{tmp_path}/paths", profile=profile, rows_per_file=5)
    listing = spark.createDataFrame([("/a/b/deep/f.txt", False, 3), ("rel/y", False, 2), ("/a/q", False, 1)], "path string, is_dir boolean, size long")
    desktop = spark.createDataFrame([("/apps/code.desktop", "[Desktop Entry]\nType=Application\nName=Code 2\nExec=code\n")], "path string, value string")
    options = {"listing": listing, "desktop_files": desktop}
    batches = BATCHES if profile is UNIX else [*BATCHES[:3], BATCHES[-1]]
    for batch in batches:
        changes = spark.createDataFrame(batch, CHANGE)
        whole = spark.createDataFrame(K.apply_changes(whole, changes, profile=profile, **options).collect(), whole.schema)
        store.apply(changes, **options)
        assert rows_of(store.read()) == rows_of(whole)
    assert store.published()[0] == len(batches)


@pytest.mark.parametrize("profile", [UNIX, WINDOWS])
def test_rows_below_paths(spark, tmp_path, profile):
    whole = base(spark, profile)
    store = pathed.PathedCatalog.build(whole, f"{tmp_path}/paths", profile=profile, rows_per_file=4)
    for asked in (["/a/b"], ["/a/b", "/a/b/c.txt", "/b"], ["/"], ["rel", "/nowhere"], [""], [None], []):
        above = spark.createDataFrame([(p,) for p in asked], "path string")
        keys = above.where("path is not null").select(K.path_key("path", profile).alias("above")).distinct()
        under = whole.join(keys, F.array_contains(paths.ancestors(K.path_key("path", profile)), F.col("above")), "left_semi")
        assert rows_of(store.below(above)) == rows_of(under), asked


def test_intervals_cover_and_stay_few(spark):
    names = [f"/d{k:03}/{k % 7}" for k in range(300)]
    ranges = spark.createDataFrame([(p,) for p in names], "p string").select(*pathed.subtree_range(F.col("p")))
    found = pathed.covering(ranges, 10)
    assert 0 < len(found) <= 10 and found == sorted(found)
    assert all(any(low <= p and p + "/x" < high for low, high in found) for p in names)


def test_a_batch_reads_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pathed, "PAGE_ROWS", 20)
    wide = K.file_rows(spark.range(20_000).select(F.format_string("/home/u%d/d%d/f%d.txt", F.col("id") % 20, F.col("id") % 400, F.col("id")).alias("path"), F.lit(1).alias("size"), F.lit(False).alias("is_dir")))
    store = pathed.PathedCatalog.build(wide, f"{tmp_path}/paths", rows_per_file=5_000)
    removed = spark.createDataFrame([("/home/u3/d3",)], "path string")
    some = store._table("rows", 0).where(pathed.inside("key", pathed.covering(removed.select(*pathed.subtree_range(F.col("path"))))))
    assert len(some.collect()) >= 50
    read = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert read < 200
    before = store.published()[0]
    store.apply(spark.createDataFrame([(1, "Removed", "/home/u3/d3", True, None)], CHANGE))
    assert spark.read.parquet(f"{tmp_path}/paths/rows/batch={before + 1}").count() == 50
    assert store.read().count() == 20_000 - 50


def test_a_feed_applies_each_batch_once(spark, tmp_path):
    store = pathed.PathedCatalog.build(base(spark, UNIX), f"{tmp_path}/paths")
    changes = spark.createDataFrame([(1, "Removed", "/a/b", True, None)], CHANGE)
    assert store.apply(changes, feed="x", feed_batch=0) == 1
    assert store.apply(changes, feed="x", feed_batch=0) == 1
    assert store.apply(changes, feed="y", feed_batch=0) == 2
    lost = spark.createDataFrame([(1, "Overflow", "/", True, None, "files")], CHANGE + ", source string")
    lost.write.parquet(f"{tmp_path}/events")
    feed = stream_changes_by_path(spark.readStream.schema(lost.schema).parquet(f"{tmp_path}/events"), store, f"{tmp_path}/progress", available_now=True)
    with pytest.raises(Exception, match="built again"):
        feed.awaitTermination()
