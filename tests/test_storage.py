import shutil

import pytest
from making import NOW, catalog, entry, queries
from pyspark.sql import functions as F

from trigrove.model import FEATURES, MAX_REQUEST, WINDOWS
from trigrove.operators import training as L
from trigrove.operators.catalog import merge_last, replace_catalog, replace_files
from trigrove.operators.index import LookupTables
from trigrove.plans.build import build_catalog
from trigrove.plans.fresh import Served, search_version, serve
from trigrove.plans.search import search
from trigrove.plans.shared import shared_folder
from trigrove.sources import clicklog, requests, snapshot, treemodel


def test_snapshot_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshot.write_snapshot(catalog(spark, entry(7, "Firefox", "App")), path, 10)
    rows, indexed = snapshot.read_snapshot(spark, path)
    assert indexed == 10 and [r["id"] for r in rows.collect()] == [7] and len(rows.first()["trigrams"]) == 9
    owner = LookupTables.of(rows).exact_terms.where("term = 'firefox'").first()["owner"]
    assert owner["id"] == 7
    snapshot.write_snapshot(catalog(spark, entry(8, "Other", "App")), path, 20)
    assert [r["id"] for r in snapshot.read_snapshot(spark, path)[0].collect()] == [8]


def test_foreign_data_is_rejected_whole(spark, tmp_path):
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read_snapshot(spark, str(tmp_path / "none"))
    bad = tmp_path / "bad" / "published"
    bad.mkdir(parents=True)
    (bad / "x.json").write_text("not an index")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read_snapshot(spark, str(tmp_path / "bad"))
    for wrong in (entry(1, "x" * 40_000), entry(1, "x", "Nothing"), entry(1, "x", tags=["t"] * 10_001)):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.check_limits(catalog(spark, wrong))
    with pytest.raises(snapshot.SnapshotError):
        snapshot.check_limits(catalog(spark, entry(1, "x"), entry(2, "y")), max_entries=1)


def test_start_up(spark, tmp_path):
    store = snapshot.VersionedTable(spark, str(tmp_path / "store"))
    scans = []

    def scan():
        scans.append(1)
        return catalog(spark, entry(1, "file"))

    apps = catalog(spark, entry(2, "App", "App"))
    names = lambda rows: sorted(r["name"] for r in rows.collect())
    assert names(build_catalog(store, scan, apps, now=1)) == ["App", "file"]
    assert names(build_catalog(store, scan, catalog(spark, entry(3, "New", "App")), now=2)) == ["New", "file"]
    assert len(scans) == 1
    build_catalog(store, scan, apps, now=3, mode="full")
    assert len(scans) == 2 and store.current().last_indexed == 3


def named_rows(rows):
    return sorted((r["id"], r["name"]) for r in rows.collect())


def test_ids_of_64_bits_and_many_generations(spark):
    """Rows without positions stand where their ids put them, however large these are."""
    big = 2**63 - 1
    old = catalog(spark, entry(big, "first"), entry(-big, "low", "App"))
    for k in range(3):
        old = merge_last(old, catalog(spark, entry(big, f"again {k}")))
    assert named_rows(old) == [(-big, "low"), (big, "again 2")]
    assert named_rows(replace_catalog(old, catalog(spark, entry(big - 1, "new", "App")))) == [(big - 1, "new"), (big, "again 2")]
    assert named_rows(replace_files(old, catalog(spark, entry(big, "scanned")))) == [(-big, "low"), (big, "scanned")]
    owner = LookupTables.of(merge_last(old, catalog(spark, entry(-5, "low", "App")))).exact_terms.where("term = 'low'").first()["owner"]
    assert owner["id"] == -5


def test_a_damaged_store_is_scanned_afresh(spark, tmp_path):
    store = snapshot.VersionedTable(spark, str(tmp_path / "store"))
    scan = lambda: catalog(spark, entry(1, "file"))
    apps = catalog(spark, entry(2, "App", "App"))
    build_catalog(store, scan, apps, now=1)
    for part in (tmp_path / "store").glob("build--1-v1-*/*/*.parquet"):
        part.write_bytes(b"not parquet")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert named_rows(build_catalog(store, lambda: catalog(spark, entry(5, "fresh")), apps, now=2)) == [(2, "App"), (5, "fresh")]
    shutil.rmtree(next((tmp_path / "store").glob("build--1-v2-*")))
    assert named_rows(build_catalog(store, scan, apps, now=3)) == [(1, "file"), (2, "App")]


def test_a_long_stored_text_keeps_its_catalog(spark, tmp_path):
    store = snapshot.VersionedTable(spark, str(tmp_path / "store"))
    store.publish(catalog(spark, entry(1, "x" * 40_000), entry(2, "command", "Command")), 1)
    scan = lambda: catalog(spark)
    assert [i for i, _ in named_rows(build_catalog(store, scan, catalog(spark), now=2))] == [1, 2]
    with pytest.raises(snapshot.SnapshotError, match=r"\[1\]"):
        build_catalog(store, scan, catalog(spark), now=3, profile=WINDOWS)


def test_of_two_writers_one_is_told(spark, tmp_path):
    store = snapshot.VersionedTable(spark, str(tmp_path / "store"))
    rows = catalog(spark, entry(1, "a"))
    assert store.publish(rows, 1) == 1 and store.publish(rows, 2, after=1) == 2
    with pytest.raises(snapshot.VersionConflict):
        store.publish(catalog(spark, entry(9, "late")), 3, after=1)
    assert store.current().number == 2 and named_rows(store.read()) == [(1, "a")]


def test_stored_tables_know_what_they_hold(spark, tmp_path):
    rows = catalog(spark, *[entry(i, "same") for i in range(30)])
    LookupTables.of(rows, 20).write(str(tmp_path / "t"))
    stored = LookupTables.read(spark, str(tmp_path / "t"))
    assert (stored.max_candidates, stored.profile) == (20, "unix")
    with pytest.raises(ValueError):
        LookupTables.read(spark, str(tmp_path / "t"), 100)
    with pytest.raises(ValueError):
        LookupTables.read(spark, str(tmp_path / "t"), 10, WINDOWS)
    with pytest.raises(ValueError):
        search(queries(spark, "same"), rows, now=NOW, tables=stored, max_candidates=50)
    with pytest.raises(ValueError):
        WINDOWS.max_candidates(5)
    assert search(queries(spark, "same"), rows, now=NOW, tables=stored, top_k=15).count() == 15
    assert search(queries(spark, " "), rows, now=NOW, tables=stored, top_k=15).count() == 15
    with pytest.raises(ValueError):
        search(queries(spark, "same"), rows, now=NOW, tables=stored, top_k=21)


def test_shared_folder_follows_the_session(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark)


BIG = "18446744073709551615"


def test_click_log(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame(
        [("test", "123", "Test", 1_700_000_000, 1)], "query string, selected_id string, selected_name string, timestamp long, rank_position int"
    ).withColumn("candidates", F.array().cast("array<struct<id:string>>"))
    clicklog.append_clicks(one, path)
    line = spark.read.text(path).first()["value"]
    assert '"selected_id":"123"' in line and "candidates" not in line
    assert clicklog.click_count(spark, path) == 1
    (tmp_path / "log" / "more.jsonl").write_text(
        f'{{"query":"q","selected_id":{BIG},"timestamp":5,"context":{{"active_app":null,"cwd":"/x"}}}}\n\n   \nbroken {{\n[1]\n'
    )
    clicks, bad = clicklog.read_clicks(spark, path)
    got = {r["selected_id"]: r for r in clicks.collect()}
    assert set(got) == {"123", BIG} and got[BIG]["context"]["cwd"] == "/x"
    assert sorted((r["line"], r["value"]) for r in bad.collect()) == [(4, "broken {"), (5, "[1]")]


def test_line_numbers_over_blocks(spark, tmp_path):
    """Files that are read in many blocks, and blocks of several files that one task reads."""
    wanted = set()
    for name, n in (("long", 5_000), ("middle", 900), ("one", 1), ("none", 0)):
        lines = ["" if k % 11 == 0 else f"broken {name} {k}" if k % 97 == 0 else '{"query":"q","selected_id":5}' + " " * (k % 50) for k in range(1, n + 1)]
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{v}\n" for v in lines))
        wanted |= {(name, k, v) for k, v in enumerate(lines, 1) if v.startswith("broken")}
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (4096, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 16)
            placed = clicklog.placed_lines(spark, str(tmp_path))
            assert (placed.select("file", "block").distinct().count() > 40) == (size == 4096)
            _, bad = clicklog.read_clicks(spark, str(tmp_path))
            found = [(r["file"].rsplit("/", 1)[1].removesuffix(".jsonl"), r["line"], r["value"]) for r in bad.collect()]
            assert len(found) == len(wanted) and set(found) == wanted
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_requests(spark):
    lines = spark.createDataFrame(
        [(i, v) for i, v in enumerate([
            '{"query":"document"}', "not-json", f'{{"query":"a","selected_id":{BIG},"rank_position":2}}', '{"query":"a","selected_id":"x","rank_position":2}',
            '{"query":"a","selected_id":5}', '{"selected":1}', " ", '{"query":"' + "x" * MAX_REQUEST + '"}', '{"query":"a","selected_id":18446744073709551616,"rank_position":1}',
        ])], "line int, value string",
    )
    asked, clicked, errors = requests.read_requests(lines, MAX_REQUEST)
    assert [(r["line"], r["query"]) for r in asked.collect()] == [(0, "document")]
    assert [(r["line"], r["selected_id"]) for r in clicked.collect()] == [(2, BIG)]
    assert {r["line"]: r["error"] for r in errors.collect()} == {
        1: "invalid request", 3: "invalid click request", 4: "invalid click request", 5: "invalid query request", 7: "request is too large", 8: "invalid click request",
    }


def logged(spark, n, labels=(1, 2)):
    lines = []
    for i in range(n):
        shown = ",".join(
            f'{{"id":{j},"name":"n","features":{{"is_exact_prefix":{"true" if j == 1 else "false"},"frecency":{0.1 * j},"edit_distance":{i % 7 / 999}}}}}' for j in labels
        )
        lines.append((f'{{"query":"q","selected_id":1,"candidates":[{shown},{{"id":9,"features":"none"}}]}}',))
    return clicklog.clicks_of(clicklog.parse_lines(spark.createDataFrame(lines, "value string")))


def test_training_gate(spark):
    for n, labels, ready in ((49, (1, 2), False), (50, (1, 2), True), (50, (1,), False)):
        clicks = logged(spark, n, labels)
        gate = L.training_gate(clicks, L.training_rows(clicks)).first()
        assert (gate["clicks"], gate["feature_rows"], gate["ready"]) == (n, n * len(labels), ready)
    assert L.train_ranker(logged(spark, 49)) is None
    row = L.training_rows(logged(spark, 1)).where("label = 1").first()
    assert (row["is_exact_prefix"], row["frecency"], row["same_directory"]) == (1.0, 0.1, 0.0)


def test_trained_model_and_its_text_agree(spark, tmp_path):
    fitted = L.train_ranker(logged(spark, 60), rounds=4)
    ranker = L.FittedRanker(fitted)
    ranker.save(str(tmp_path / "ranker"))
    rows = spark.range(20).select(
        F.struct(*[(F.col("id") % 2 if n == "is_exact_prefix" else F.col("id") / 20 if n == "frecency" else F.lit(0.0)).cast("double").alias(n) for n in FEATURES]).alias("features")
    )
    direct = [r["score"] for r in L.FittedRanker.load(str(tmp_path / "ranker")).score(rows).orderBy("features").collect()]
    treemodel.write_tree_model(spark, fitted.stages[-1], str(tmp_path / "text"))
    text = [r["score"] for r in treemodel.read_tree_model(spark, str(tmp_path / "text")).score(rows).orderBy("features").collect()]
    assert len(set(direct)) > 1 and direct == pytest.approx(text, abs=1e-6)


def test_results_say_how_fresh_they_are(spark, tmp_path):
    store = snapshot.VersionedTable(spark, str(tmp_path / "store"))
    asked = queries(spark, "document")
    with pytest.raises(snapshot.SnapshotError):
        search_version(asked, store, now=NOW)
    store.publish(catalog(spark, entry(1, "document")), NOW - 10)
    first = search_version(asked, store, now=NOW)
    store.publish(catalog(spark, entry(1, "document"), entry(2, "documents")), NOW - 1)
    ticks = iter([5.0, 5.25])
    served = serve(first, str(tmp_path / "first"), lambda: next(ticks))  # of the version that was there when they were asked for
    assert served == Served(rows=1, stale_rows=1, catalog_version=1, latency_ms=250)
    later = serve(search_version(asked, store, now=NOW), str(tmp_path / "later"))
    assert (later.rows, later.stale_rows, later.catalog_version) == (2, 0, 2)
    none = serve(search_version(queries(spark, "zzzz"), store, now=NOW), str(tmp_path / "none"))
    assert (none.rows, none.stale_rows, none.catalog_version) == (0, 0, None)
    assert "index_stale" in spark.read.parquet(str(tmp_path / "none")).columns
