from making import NOW, catalog, entry, found, queries
from pyspark.sql import functions as F

from trigrove.functions import text
from trigrove.model import WINDOWS
from trigrove.operators import catalog as K
from trigrove.plans.search import ranked_rows
from trigrove.operators.index import LookupTables
from trigrove.sources import desktop, files, fixed

CODE = "[Desktop Entry]\nType=Application\nName=Visual Studio Code\nGenericName=Text Editor\nKeywords=vscode;development;\nExec=/usr/bin/code %F\n"
NVIDIA = "[Desktop Entry]\nType=Application\nName=NVIDIA X Server Settings\nCategories=System;Settings;\nExec=nvidia-settings\n"
HIDDEN = "[Desktop Entry]\nType=Application\nName=Keyboard\nNoDisplay=true\n"
PANEL = "com.system76.CosmicSettings"


def texts(spark, **contents):
    rows = [(f"/apps/{name.replace('__', '.').replace('_', '-')}.desktop", value) for name, value in contents.items()]
    return spark.createDataFrame(rows, "path string, value string")


def test_desktop_entries(spark):
    rows = desktop.desktop_entries(
        spark.createDataFrame(
            [
                ("/a/org.example.App.desktop", "[Desktop Entry]\r\nType=Application\r\nName=Example\r\nName=Other\r\nIcon=example\r\n"),
                (f"/a/{PANEL}.Sound.desktop", "[Desktop Entry]\nType=Application\nName=Sound\n"),
                ("/a/code.desktop", CODE),
                ("/a/nvidia-settings.desktop", NVIDIA),
                (f"/a/{PANEL}.Keyboard.desktop", HIDDEN),
                ("/a/background-helper.desktop", HIDDEN),
                ("/a/link.desktop", "[Desktop Entry]\nType=Link\nName=L\n"),
                ("/a/gone.desktop", "[Desktop Entry]\nHidden=true\nName=L\n"),
                ("/a/nameless.desktop", "[Desktop Entry]\n#Name=L\n[Other]\nName=L\n"),
                ("/a/spaced.desktop", "  [Desktop Entry]  \nName =no\n Name=Spaced \n[X]\nType=Link\n"),
                ("/a/empty.desktop", ""),
            ],
            "path string, value string",
        )
    )
    got = {r["name"]: r for r in rows.withColumn("grams", text.terms_trigrams(text.search_terms(F.col("name"), F.col("metadata.tags")))).collect()}
    kinds = {n: r["entry_type"] for n, r in got.items()}
    assert kinds == {
        "Example": "App", "Sound": "Setting", "Visual Studio Code": "App", "NVIDIA X Server Settings": "Setting", "Keyboard": "Setting", "Spaced": "App",
    }
    assert got["Example"]["icon_path"] == "example" and got["Example"]["path"] == "org.example.App"
    code = got["Visual Studio Code"]["metadata"]["tags"]
    assert code == ["Text Editor", "vscode", "development", "code", "VSC", "VS Code", "code editor"]
    wanted = {"  vs code  "[i : i + 3] for i in range(9)}
    assert wanted <= set(got["Visual Studio Code"]["grams"])
    assert "nvidia settings" in got["NVIDIA X Server Settings"]["metadata"]["tags"]


def test_aliases_are_found_by_natural_queries(spark):
    apps = desktop.desktop_entries(texts(spark, code=CODE, nvidia_settings=NVIDIA))
    whole = K.replace_catalog(catalog(spark), apps.withColumn("position", F.monotonically_increasing_id()).unionByName(fixed.unix_settings(spark).withColumn("position", F.col("position") + 2**40)))
    ranked = ranked_rows(queries(spark, "vs code", "vscode", "nvidia settings", "general settings"), LookupTables.of(whole), None, now=NOW)
    first = {r["query_id"]: r["name"] for r in ranked.where("rank = 1").collect()}
    assert first == {"0": "Visual Studio Code", "1": "Visual Studio Code", "2": "NVIDIA X Server Settings", "3": "Settings"}


def test_desktop_files_are_read_to_a_depth(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    for folder in (tmp_path, deep.parent, deep):
        (folder / f"{folder.name[:1]}.desktop").write_text(CODE)
    (tmp_path / "x.txt").write_text(CODE)
    names = lambda rows: sorted(r["path"].rsplit("/", 1)[1] for r in rows.collect())
    assert len(names(desktop.read_desktop_files(spark, [str(tmp_path)]))) == 2
    assert len(names(desktop.read_desktop_files(spark, [str(tmp_path)], 1))) == 1
    assert len(names(desktop.read_desktop_files(spark, [str(tmp_path), str(tmp_path / "a")]))) == 3


def test_file_catalog(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "report.txt").write_text("hello")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "hidden.js").write_text("x")
    root = str(tmp_path)
    for dialect in ("unix", "windows"):
        profile = WINDOWS if dialect == "windows" else K.UNIX
        rows = files.file_catalog(files.list_files(spark, [root]), [root], ("node_modules",), profile)
        got = {r["name"]: r["metadata"] for r in rows.collect()}
        assert set(got) == {"report.txt", "docs", tmp_path.name}
        assert (got["report.txt"]["file_type"], got["report.txt"]["file_size"], got["docs"]["is_dir"]) == ("txt", 5, True)
        assert got["docs"]["category"] == ("Folder" if dialect == "windows" else None)


def test_shortcuts_and_fixed_catalogs(spark):
    listing = spark.createDataFrame(
        [("/menu", "/menu/Visual Studio Code.lnk"), ("/menu", "/menu/Tools/Sub/Paint.EXE"), ("/menu", "/menu/Tools/Uninstall.lnk"), ("/menu", "/menu/read.txt")],
        "root string, path string",
    )
    got = {r["name"]: r["metadata"] for r in files.shortcut_apps(listing).collect()}
    assert set(got) == {"Visual Studio Code", "Paint"}
    assert got["Visual Studio Code"]["tags"] == ["menu", "VSC", "vs code", "vscode", "code editor"]
    assert got["Visual Studio Code"]["category"] == "Applications" and got["Paint"]["category"] == "Tools" and got["Paint"]["tags"] == ["Sub"]
    assert fixed.unix_settings(spark).count() == 22
    known = fixed.windows_settings(spark).unionByName(fixed.windows_commands(spark))
    assert {r["entry_type"]: r["n"] for r in known.groupBy("entry_type").agg(F.count("*").alias("n")).collect()} == {"Setting": 51, "Command": 20}
    assert known.where("name in ('Windows Update', 'Task Manager')").count() == 2


def test_merge_and_replace(spark):
    old = catalog(spark, entry(1, "f"), entry(2, "A", "App"), entry(3, "s", "Setting"), entry(4, "c", "Command", count=2, last=9))
    new = catalog(spark, entry(5, "B", "App"), entry(6, "b", "App"), entry(5, "Again", "App"), entry(7, "B", "Setting"), entry(1, "taken", "App"), entry(4, "c2", "Command"))
    new = new.withColumn("position", F.expr("case name when 'B' then if(entry_type = 'App', 0, 3) when 'b' then 1 when 'Again' then 2 when 'taken' then 4 else 5 end").cast("long"))
    pairs = lambda rows: sorted((r["id"], r["name"]) for r in rows.collect())
    merged = K.merge_last(old, new)
    assert pairs(merged) == [(1, "taken"), (2, "A"), (3, "s"), (4, "c2"), (5, "Again"), (6, "b"), (7, "B")]
    assert [r["id"] for r in merged.orderBy("generation", "position").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert pairs(K.replace_catalog(old, new)) == [(1, "f"), (4, "c"), (5, "B"), (7, "B")]
    assert pairs(K.replace_catalog(old, new, WINDOWS)) == [(1, "taken"), (4, "c2"), (5, "Again"), (7, "B")]
    assert pairs(K.replace_files(old, catalog(spark, entry(9, "g")))) == [(2, "A"), (3, "s"), (4, "c"), (9, "g")]
    carried = K.carry_usage(old, new).where("id = 4").first()
    assert (carried["access_count"], carried["last_accessed"]) == (2, 9)


def test_roots(spark):
    roots = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    kept = lambda rows: sorted(r["path"] for r in rows.collect())
    assert kept(K.distinct_roots(roots("~/", "~/Desktop", "~/Documents", "~/Downloads"), "/home/me")) == ["/home/me"]
    assert kept(K.distinct_roots(roots("/a/b", "/a/bc", "/a/b/c", "/a/b"))) == ["/a/b", "/a/bc"]
    assert len(kept(K.distinct_roots(roots("C:\\A", "c:\\a\\B"), caseless=True))) == 1


def test_subtrees(spark):
    rows = catalog(spark, entry(1, "x", path="/a/b"), entry(2, "y", path="/a/bc"), entry(3, "z", path="/a/b/c/d"), entry(4, "app", "App", path="/a/b/q"))
    gone = spark.createDataFrame([("/a/b",)], "path string")
    left = lambda r: sorted(x["id"] for x in r.collect())
    assert left(K.drop_subtrees(rows, gone)) == [2]
    assert left(K.drop_subtrees(rows, gone, WINDOWS)) == [2, 4]
    made = desktop.desktop_entries(texts(spark, code=CODE))
    assert left(K.drop_subtrees(made, spark.createDataFrame([("/apps",)], "path string"))) != []
    assert left(K.drop_subtrees(made, spark.createDataFrame([("/apps/code.desktop",)], "path string"))) == []


CHANGE = "seq long, kind string, path string, is_dir boolean, size long"


def test_apply_changes(spark):
    base = catalog(spark, entry(1, "old", path="/d/old"), entry(2, "keep", path="/e/keep"), entry(3, "d", path="/d", is_dir=True))
    paths = lambda rows: sorted(r["path"] for r in rows.collect())

    def after(*changes, **options):
        return paths(K.apply_changes(base, spark.createDataFrame(list(changes), CHANGE), **options))

    assert after((1, "Created", "/n.txt", False, 3)) == ["/d", "/d/old", "/e/keep", "/n.txt"]
    assert after((1, "Created", "/n.txt", False, 3), (2, "Removed", "/n.txt", False, None)) == ["/d", "/d/old", "/e/keep"]
    assert after((1, "Removed", "/d", True, None), (2, "Created", "/d/new", False, 1)) == ["/d/new", "/e/keep"]
    assert after((1, "Created", "/d/new", False, 1), (2, "Removed", "/d", True, None)) == ["/e/keep"]
    assert after((1, "Modified", "/d", True, None)) == ["/d", "/d/old", "/e/keep"]
    listing = spark.createDataFrame([("/d/in", 5, False), ("/d/sub/x", 6, False), ("/f/y", 1, False)], "path string, size long, is_dir boolean")
    assert after((1, "Created", "/d", True, None), listing=listing) == ["/d", "/d/in", "/d/sub/x", "/e/keep"]
    assert after((1, "Created", "/apps/code.desktop", False, 9), desktop_files=texts(spark, code=CODE)) == ["/d", "/d/old", "/e/keep", "code"]


def test_windows_replacing_keeps_counters(spark):
    old = catalog(spark, entry(1, "a.txt", count=42, last=7), entry(2, "App", "App", count=9, last=5), entry(3, "gone.txt", count=1))
    files = catalog(spark, entry(1, "a.txt"), entry(4, "new.txt"))
    counts = lambda rows: {r["id"]: (r["access_count"], r["last_accessed"]) for r in rows.collect()}
    assert counts(K.replace_files(old, files, WINDOWS)) == {1: (42, 7), 2: (9, 5), 4: (0, 0)}
    assert counts(K.replace_files(old, files))[1] == (0, 0)
    assert counts(K.replace_catalog(old, catalog(spark, entry(2, "App", "App"), entry(5, "Other", "App")), WINDOWS)) == {1: (42, 7), 2: (9, 5), 3: (1, 0), 5: (0, 0)}
