from making import values
from pyspark.sql import functions as F

from trigrove.functions import paths, text

lit = F.lit


def strings(*items):
    return F.array(*[lit(i) for i in items]).cast("array<string>")


def test_trigrams_and_overlap(spark):
    got = values(
        spark,
        document=F.size(text.trigrams(lit("document"))),
        upper=text.trigrams(lit("Résumé")),
        lower=text.trigrams(lit("résumé")),
        empty=text.trigrams(lit("")),
        astral=F.size(text.trigrams(lit("a😀b"))),
        embedded=text.overlap(text.trigrams(lit("document")), text.trigrams(lit("important_document"))),
        dropped=text.overlap(text.trigrams(lit("document")), text.trigrams(lit("dcument"))),
        none=text.overlap(strings(), strings("abc")),
        terms=F.size(text.terms_trigrams(strings("ab", "AB", "cd"))),
    )
    assert got["document"] == 10
    assert got["upper"] == got["lower"] and len(got["upper"]) == 8
    assert got["empty"] == ["   "] and got["astral"] == 5
    assert got["embedded"] == 0.8 and got["dropped"] == 0.7 and got["none"] == 0.0
    assert got["terms"] == 8


def test_distances(spark):
    got = values(
        spark,
        deletion=text.bounded_distance(lit("document"), lit("dcument")),
        accents=text.bounded_distance(lit("résumé"), lit("resume")),
        far=text.bounded_distance(lit("document"), lit("xyz")),
        case=text.bounded_distance(lit("ABC"), lit("abc")),
        least=text.least_distance(lit("abc"), strings("abcdefgh", "abd")),
        capped=text.least_distance(lit(""), strings("x" * 1500)),
        short=text.within_distance(lit(""), strings("vc", "visual code")),
    )
    assert got == {"deletion": 1, "accents": 2, "far": None, "case": 0, "least": 1, "capped": 999, "short": True}


def test_grades_and_normal_form(spark):
    terms = strings("firefox", "web browser")
    got = values(
        spark,
        exact=text.match_quality(lit("firefox"), terms),
        prefix=text.match_quality(lit("web"), terms),
        inside=text.match_quality(lit("fox"), terms),
        contains=text.match_quality(lit("fox"), terms, "contains"),
        contains_exact=text.match_quality(lit("firefox"), terms, "contains"),
        trimmed=text.normalise(lit("\t\u00a0Ab C \n")),
        null=text.normalise(lit(None).cast("string")),
    )
    assert got == {
        "exact": 2, "prefix": 1, "inside": 0, "contains": 1, "contains_exact": 3, "trimmed": "ab c", "null": "",
    }


def test_aliases_and_tags(spark):
    got = values(
        spark,
        code=text.aliases(lit("Visual Studio Code")),
        two=text.aliases(lit("Date & Time")),
        one=text.aliases(lit("Terminal")),
        settings=text.aliases(lit("Settings")),
        windows=text.aliases(lit("Windows File Explorer"), windows=True),
        tags=text.distinct_tags(strings("Name", " name ", "b", "B ", " ", "c", "b"), lit("Name")),
        no_tags=text.distinct_tags(strings(), lit("Name")),
    )
    assert got["code"] == ["VSC", "VS Code", "vs code", "vscode", "code editor"]
    assert got["two"] == ["DT"]
    assert got["one"] == ["console", "shell"]
    assert got["settings"] == ["preferences", "control panel", "system settings", "general settings"]
    assert got["windows"] == ["WFE", "files", "file manager"]
    assert got["tags"] == ["b", "c"] and got["no_tags"] == []


def test_paths(spark):
    p = lit
    got = values(
        spark,
        ext=F.array(*[paths.extension(p(x)) for x in ("/a/b.TXT", "/a/.bashrc", "a.tar.gz", "foo.", "a.b/c")]),
        name=F.array(*[paths.base_name(p(x)) for x in ("/a/b.txt", "/a/b/", "c", "/")]),
        parent=F.array(*[paths.parent(p(x)) for x in ("/a/b", "a", "/a", "/", "a/b/")]),
        stem=F.array(*[paths.stem(p(x)) for x in ("/a/org.x.App.desktop", ".rc", "x")]),
        above=paths.ancestors(p("/a/b/c")),
        clean=F.array(*[paths.clean(p(x)) for x in ("/a//b/./c/", "/", "a/.hidden")]),
        under=F.array(paths.lies_under(p("/a/bc"), p("/a/b")), paths.lies_under(p("/a/b/c"), p("/a/b")), paths.lies_under(p("/x"), p("/"))),
        same_id=paths.stable_id(p("File"), p(r"C:\Data\Report.txt"), True) == paths.stable_id(p("File"), p(r"c:\data\report.TXT"), True),
        other_id=paths.stable_id(p("File"), p("/a")) == paths.stable_id(p("App"), p("/a")),
    )
    assert got["ext"] == ["TXT", None, "gz", "", None]
    assert got["name"] == ["b.txt", "b", "c", "/"]
    assert got["parent"] == ["/a", "", "/", None, "a"]
    assert got["stem"] == ["org.x.App", ".rc", "x"]
    assert got["above"] == ["/", "/a", "/a/b", "/a/b/c"]
    assert got["clean"] == ["/a/b/c", "/", "a/.hidden"]
    assert got["under"] == [False, True, True]
    assert got["same_id"] is True and got["other_id"] is False


def test_exclusion(spark):
    names = ("target", ".git")
    got = values(
        spark,
        scan=F.array(*[
            paths.scan_keeps(lit("/home/.me"), lit(x), names)
            for x in ("/home/.me/a", "/home/.me/.b/c", "/home/.me/target/x", "/home/.me")
        ]),
        root=paths.scan_keeps(lit("/target/x"), lit("/target/x/y"), names),
        event=F.array(*[
            paths.event_keeps(lit(x), ["/home/.me", "/srv"], names)
            for x in ("/home/.me/a", "/home/.me/.b/c", "/srv/target/x", "/other/a", "/srv")
        ]),
        windows=F.array(
            paths.event_keeps(lit(r"C:\Work\OBJ\x"), [], ("obj",), True), paths.event_keeps(lit(r"C:\.x\y"), [], ("obj",), True)
        ),
    )
    assert got["scan"] == [True, False, False, True]
    assert got["root"] is False
    assert got["event"] == [True, False, False, False, True]
    assert got["windows"] == [False, True]


def test_windows_roots_are_respected(spark):
    keeps = lambda path: paths.event_keeps(lit(path), ["C:\\Data\\"], ("obj",), True)
    got = values(spark, windows=F.array(*[keeps(x) for x in (r"c:\data\a.txt", "C:/DATA", r"C:\Database\a", r"D:\Data\a", r"C:\Data\OBJ\a")]))
    assert got["windows"] == [True, True, False, False, False]


def test_expressions_of_shortcuts_are_not_repeated(spark):
    """Nested path functions were written out again in every expression over them, which took 0.7 ms a row."""
    from trigrove.sources.files import shortcut_apps

    listing = spark.createDataFrame([("/menu", "/menu/A/B/Some Tool.lnk")], "root string, path string")
    rows = shortcut_apps(listing).select("name", "metadata")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 60
    row = rows.first()
    assert (row["name"], row["metadata"]["category"], row["metadata"]["tags"]) == ("Some Tool", "A", ["B", "ST"])
