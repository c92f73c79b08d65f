import json

import pytest
from making import NOW, catalog, entry, queries
from pyspark.sql import functions as F

from trigrove.model import QUERY, USAGE, WINDOWS
from trigrove.operators.catalog import apply_changes
from trigrove.operators.index import LookupTables
from trigrove.plans.search import search
from trigrove.sources.clicklog import read_clicks
from trigrove.sources.snapshot import VersionedTable
from trigrove.streaming.changes import apply_batch, stream_changes, translate_events
from trigrove.streaming.coalesce import CHANGE, coalesced, drain
from trigrove.streaming.clicks import ClickStores, record_batch, stream_clicks
from trigrove.streaming.queries import stream_queries

EVENT = "seq long, kind string, path string, new_path string, is_dir boolean, size long, source string"


def drop(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def event(seq, kind, path, new_path=None, source="files"):
    return {"seq": seq, "kind": kind, "path": path, "new_path": new_path, "is_dir": False, "size": 1, "source": source}


def test_changes_of_a_path_over_several_batches_leave_once(spark, tmp_path):
    feed = tmp_path / "feed"
    row = lambda seq, kind, path, source="files": {"seq": seq, "kind": kind, "path": path, "is_dir": False, "size": seq, "source": source}
    drop(feed, "1.json", row(1, "Created", "/r/a"), row(2, "Created", "/r/b"), row(4, "Modified", "/r/a"))
    drop(feed, "2.json", row(3, "Removed", "/r/a"), row(5, "Removed", "/r/b"), row(6, "Modified", "/r/b", "catalog"))
    drop(feed, "3.json", row(7, "Created", "/r/b"), row(8, "Created", "/r/c"))
    changes = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).json(str(feed))
    sink = str(tmp_path / "sink")
    query = (
        coalesced(changes, 15_000).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(processingTime="100 milliseconds").start()
    )
    drain(query)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    found = sorted((r["seq"], r["kind"], r["path"], r["size"], r["source"]) for r in spark.read.parquet(sink).collect())
    assert found == [(4, "Modified", "/r/a", 4, "files"), (6, "Modified", "/r/b", 6, "catalog"), (7, "Created", "/r/b", 7, "files"), (8, "Created", "/r/c", 8, "files")]


def test_renames_become_two_changes(spark):
    rows = spark.createDataFrame(
        [(1, "rename", "/r/old", "/r/new", False, 1, "files"), (2, "rename", "/r/only", None, False, 1, "files"), (3, "access", "/r/x", None, False, 1, "files"),
         (4, "create", "/r/.git/x", None, False, 1, "files"), (5, "create", "/other/x", None, False, 1, "files")], EVENT,
    )
    got = [(r["kind"], r["path"]) for r in translate_events(rows, ["/r"]).orderBy("seq").collect()]
    assert got == [("Removed", "/r/old"), ("Created", "/r/new"), ("Modified", "/r/only")]


def test_change_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    store = VersionedTable(spark, str(tmp_path / "store"))
    store.publish(catalog(spark, entry(1, "app", "App")), 1)
    calls = []

    def rebuild():
        calls.append("rebuild")
        return catalog(spark, entry(2, "fresh", "App"))

    def rescan():
        calls.append("rescan")
        return catalog(spark, entry(3, "scanned", path="/r/scanned"))

    def run():
        events = spark.readStream.schema(EVENT).json(str(feed))
        query = stream_changes(
            translate_events(events, ["/r"]), store, str(tmp_path / "progress"), available_now=True, rebuild=rebuild, rescan=rescan, now=lambda: NOW
        )
        query.awaitTermination()
        names.add(f"changes-{query.id}")
        return sorted(r["path"] for r in store.read().collect())

    names = set()
    drop(feed, "1.json", event(1, "create", "/r/notes.txt"))
    assert run() == ["/home/app", "/r/notes.txt"]
    drop(feed, "2.json", event(2, "remove", "/r/notes.txt"), event(3, "create", "/r/b"))
    assert run() == ["/home/app", "/r/b"]
    version = store.current().number
    drop(feed, "3.json", event(4, "modify", "/menu/x", source="catalog"), event(5, "modify", "/menu/y", source="catalog"))
    assert run() == ["/home/fresh", "/r/b"] and calls == ["rebuild"]
    drop(feed, "4.json", event(6, "overflow", "/"))
    assert run() == ["/home/fresh", "/r/scanned"] and calls == ["rebuild", "rescan"]
    assert store.current().number == version + 2 and store.current().last_indexed == NOW
    # A batch of the feed that comes again changes nothing; the feed has one name over all runs from its checkpoint.
    (name,) = names
    again = spark.createDataFrame([(9, "Created", "/r/late", False, 1, "files")], "seq long, kind string, path string, is_dir boolean, size long, source string")
    assert apply_batch(store, again, 3, feed=name) is False and store.current().number == version + 2


def test_stream_equals_batch(spark, tmp_path):
    base = catalog(spark, entry(1, "a", path="/r/d/a"), entry(2, "b", path="/r/b"))
    rows = [(i, k, p, False, i) for i, (k, p) in enumerate(
        [("Created", "/r/x"), ("Removed", "/r/d"), ("Created", "/r/d/n"), ("Modified", "/r/b"), ("Removed", "/r/x"), ("Created", "/r/x")], 1)]
    changes = spark.createDataFrame(rows, "seq long, kind string, path string, is_dir boolean, size long")
    batch = sorted((r["path"], r["metadata"]["file_size"]) for r in apply_changes(base, changes).collect())
    store = VersionedTable(spark, str(tmp_path / "store"))
    store.publish(base, 1)
    for row in rows:
        drop(tmp_path / "feed", f"{row[0]}.json", dict(zip(["seq", "kind", "path", "is_dir", "size"], row)))
    feed = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 6).json(str(tmp_path / "feed")).withColumn("source", F.lit("files"))
    stream_changes(feed, store, str(tmp_path / "progress"), available_now=True).awaitTermination()
    assert sorted((r["path"], r["metadata"]["file_size"]) for r in store.read().collect()) == batch


def test_windows_changes_meet_whatever_the_slash_and_case(spark):
    base = catalog(spark, entry(1, "A.txt", path=r"c:\d\A.txt"), entry(2, "b", path=r"C:\Other\b"))
    rows = [(1, "Created", r"C:\Data\New", True, None), (2, "Modified", "c:/data/new", True, None), (3, "Removed", r"C:\D", None, None), (4, "Created", r"C:\x.desktop", False, 5)]
    changes = spark.createDataFrame(rows, "seq long, kind string, path string, is_dir boolean, size long").withColumn("seq", F.col("seq"))
    listing = spark.createDataFrame([(r"C:\data\new\deep\f.TXT", False, 7), (r"C:\data\newer", False, 8)], "path string, is_dir boolean, size long")
    created = changes.where("seq <> 2")
    got = {r["path"] for r in apply_changes(base, created, listing=listing, profile=WINDOWS).collect()}
    assert got == {r"C:\Other\b", r"C:\Data\New", r"C:\data\new\deep\f.TXT", r"C:\x.desktop"}
    last = {r["path"] for r in apply_changes(base, changes, profile=WINDOWS).collect()}
    assert last == {r"C:\Other\b", "c:/data/new", r"C:\x.desktop"}


def test_lost_work_is_an_error(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "store"))
    store.publish(catalog(spark, entry(1, "a")), 1)
    row = lambda kind, path, source="files": spark.createDataFrame([(1, kind, path, False, 1, source)], "seq long, kind string, path string, is_dir boolean, size long, source string")
    for batch, changes in enumerate((row("Overflow", "/"), row("Modified", "/menu/x", "catalog"), row("Created", "/apps/x.desktop"))):
        with pytest.raises(Exception, match="is needed"):
            apply_batch(store, changes, batch, now=lambda: NOW)
    assert store.current().number == 1


def test_first_click_adds_to_the_entrys_own_count(spark, tmp_path):
    tables = LookupTables.of(catalog(spark, entry(1, "alpha document", count=42, last=5), entry(2, "beta document", count=7)))
    stores = ClickStores(VersionedTable(spark, str(tmp_path / "usage"), USAGE, None), str(tmp_path / "log"), str(tmp_path / "rejects"))
    schema = "query_id string, query string, selected_id string, timestamp long, rank_position int"
    for batch in range(2):
        record_batch(spark.createDataFrame([(f"q{batch}", "document", "1", NOW + batch, 1)], schema), batch, tables, stores, now=lambda: NOW)
    assert [tuple(r) for r in stores.usage.read().collect()] == [(1, 44, NOW + 1)]


def test_click_stream(spark, tmp_path):
    tables = LookupTables.of(catalog(spark, entry(1, "alpha document"), entry(2, "beta document")))
    stores = ClickStores(VersionedTable(spark, str(tmp_path / "usage"), USAGE, None), str(tmp_path / "log"), str(tmp_path / "rejects"))
    feed = tmp_path / "clicks"
    click = {"query_id": "c1", "query": "document", "selected_id": "2", "timestamp": NOW, "rank_position": 40}
    drop(feed, "1.json", click, {**click, "query_id": "c2", "selected_id": "99"}, {**click, "query_id": "c3", "timestamp": NOW + 5})
    schema = "query_id string, query string, selected_id string, timestamp long, rank_position int"
    stream_clicks(spark.readStream.schema(schema).json(str(feed)), tables, stores, str(tmp_path / "progress"), available_now=True, now=lambda: NOW).awaitTermination()
    assert [tuple(r) for r in stores.usage.read().collect()] == [(2, 2, NOW + 5)]
    clicks, bad = read_clicks(spark, stores.log)
    rows = clicks.select("selected_id", "selected_name", "rank_position", F.size("candidates").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("2", "beta document", 10, 2)] * 2 and bad.count() == 0
    assert [r["query_id"] for r in spark.read.json(stores.rejects).collect()] == ["c2"]
    first = search(queries(spark, "document"), tables.catalog, stores.usage.read(), now=NOW, tables=tables).where("rank = 1").first()
    assert first["id"] == 2


def test_query_stream(spark, tmp_path):
    tables = LookupTables.of(catalog(spark, entry(1, "document"), entry(2, "other")))
    feed = tmp_path / "queries"
    drop(feed, "1.json", {"query_id": "a", "query": "documnt"}, {"query_id": "b", "query": "nothing like it"})
    drop(feed, "2.json", {"query_id": "c", "query": "other"})
    stream = spark.readStream.schema(QUERY).option("maxFilesPerTrigger", 1).json(str(feed))
    stream_queries(stream, lambda: tables, lambda: None, str(tmp_path / "sink"), str(tmp_path / "progress"), now=lambda: NOW, available_now=True).awaitTermination()
    got = {(r["query_id"], r["id"]) for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    assert got == {("a", 1), ("c", 2)}


def test_feeds_number_their_own_batches(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "store"))
    row = lambda path: spark.createDataFrame([(1, "Created", path, False, 1, "files")], "seq long, kind string, path string, is_dir boolean, size long, source string")
    assert apply_batch(store, row("/a"), 0, feed="one", now=lambda: NOW) and apply_batch(store, row("/b"), 0, feed="two", now=lambda: NOW)
    assert not apply_batch(store, row("/c"), 0, feed="two", now=lambda: NOW)
    assert {r["path"] for r in store.read().collect()} == {"/a", "/b"}


def test_counts_of_another_writer_stay(spark, tmp_path, monkeypatch):
    tables = LookupTables.of(catalog(spark, entry(1, "alpha document")))
    stores = ClickStores(VersionedTable(spark, str(tmp_path / "usage"), USAGE, None), str(tmp_path / "log"), str(tmp_path / "rejects"))
    schema = "query_id string, query string, selected_id string, timestamp long, rank_position int"
    click = lambda name: spark.createDataFrame([(name, "document", "1", NOW, 1)], schema)
    publish, late = VersionedTable.publish, []

    def interrupted(self, *args, **options):
        if not late:
            late.append(True)
            record_batch(click("b"), 0, tables, stores, feed="other", now=lambda: NOW)
        return publish(self, *args, **options)

    monkeypatch.setattr(VersionedTable, "publish", interrupted)
    assert record_batch(click("a"), 0, tables, stores, feed="one", now=lambda: NOW)
    assert [tuple(r) for r in stores.usage.read().collect()] == [(1, 2, NOW)]


def test_given_tables_are_streams_as_files_and_as_folders(spark, data, tmp_path):
    from trigrove.plans import tables as T
    from trigrove.plans.workload import _stream

    part = T.read(spark, data, "part")
    part.repartition(3).write.parquet(str(tmp_path / "part.parquet"))
    for folder in (data, str(tmp_path)):
        sink = str(tmp_path / "sink" / folder.strip("/").replace("/", "-"))
        feed = _stream(spark, folder, "part").writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + "-progress")
        feed.trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(sink).count() == part.count() > 0


def test_strays_are_in_no_catalog(spark, data):
    from trigrove.plans import tables as T
    from trigrove.plans.workload import _strays, clicks

    part = spark.range(90_000, 901_000).select(F.col("id").alias("p_partkey"), F.lit("large bolt").alias("p_name"))  # as many parts as of a large table
    events = T.read(spark, data, "events").where("event_type = 'view'")
    picked = clicks(_strays(events), part)
    assert picked.count() == events.count() > 0
    assert picked.where("selected_name is not null").isEmpty()
