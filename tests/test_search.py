import random
from collections import defaultdict

import pytest
from making import NOW, catalog, entry, found, queries
from pyspark.sql import functions as F

import __spark_entry__
from trigrove import LookupTables, search
from trigrove.model import UNIX, WINDOWS, parse_routes
from trigrove.operators import intent as I
from trigrove.plans.search import ranked_rows, retrieve


def test_typo_exact_and_empty_queries_find_the_document(spark):
    one = catalog(spark, entry(1, "document", count=1, last=NOW))
    assert found(search(queries(spark, "document", "dcument", "   "), one, now=NOW)) == {"0": [1], "1": [1], "2": [1]}


def test_flagship_query(spark):
    rows = __spark_entry__.entry(spark).orderBy("rank").collect()
    assert [(r["id"], r["name"], round(r["score"], 6)) for r in rows[:3]] == [
        (1, "small widget", 0.765), (7, "small widget", 0.765), (107, "small widget", 0.765),
    ]


def test_class_filters(spark):
    shared = catalog(spark, *[entry(i, "Shared Name", t) for i, t in enumerate(("App", "File", "Setting", "Command"), 1)])
    expected = {
        ("unix", "All"): [1],  # an application term is looked for among applications only
        ("unix", "Settings"): [],
        ("windows", "All"): [1, 2, 4],  # and in every class as an exact term, which its last entry owns
        ("windows", "Files"): [2],
        ("windows", "Settings"): [3, 4],
    }
    for (profile, chosen), ids in expected.items():
        got = found(search(queries(spark, "shared name"), shared, now=NOW, profile=profile, class_filter=chosen))
        assert got.get("0", []) == ids, (profile, chosen)


def test_used_entries_come_first(spark):
    two = catalog(spark, entry(1, "alpha document"), entry(2, "beta document"))
    usage = spark.createDataFrame([(2, 5, NOW - 60)], "entry_id long, access_count long, last_accessed long")
    assert found(search(queries(spark, "document"), two, usage, now=NOW))["0"][0] == 2


def test_extension_lookup_and_last_owner(spark):
    rows = catalog(
        spark, entry(1, "notes.pdf", file_type="pdf"), entry(2, "same name"), entry(3, "same name"), entry(4, "zz notes.txt", file_type="txt")
    )
    tables = LookupTables.of(rows)
    asked = queries(spark, "notes.pdf", "same name")
    steps = retrieve(asked, tables, None, now=NOW)
    got = {(r["text"], r["id"]): (r["by_overlap"], r["by_exact"]) for r in steps.candidates.collect()}
    assert got[("notes.pdf", 1)] == (True, True)
    assert got[("same name", 3)] == (True, True) and got[("same name", 2)] == (True, False)


def test_intents(spark):
    rows = catalog(
        spark, entry(1, "Firefox", "App"), entry(2, "bluetooth", "Setting"), entry(3, "a.pdf", file_type=".PDF"),
    )
    t = LookupTables.of(rows)
    texts = queries(spark, "firefox", "notes.pdf", "open bluetooth please", "something").select(F.col("query").alias("text"))
    got = {r["text"]: (r["intent"], r["keyword"]) for r in I.classify(texts, t.app_terms, t.extensions, t.setting_words).collect()}
    assert got == {
        "firefox": ("ExactApp", "firefox"), "notes.pdf": ("FileExtension", "pdf"),
        "open bluetooth please": ("Setting", "bluetooth"), "something": ("Mixed", None),
    }


def test_hundred_thousand_files(spark):
    files = spark.range(100_000).select(
        "id", F.when(F.col("id") == 99_999, "document").otherwise(F.format_string("sample_file_%06d.txt", "id")).alias("name")
    )
    empty = spark.createDataFrame([], catalog(spark, entry(1, "x")).schema)
    rows = files.select(
        *[
            {"id": F.col("id"), "name": F.col("name"), "entry_type": F.lit("File"), "path": F.concat(F.lit("/"), "name"),
             "metadata": F.struct(F.lit(None).cast("string").alias("file_type"), F.lit(1).cast("long").alias("file_size"),
                                  F.lit(False).alias("is_dir"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("category"))
             }.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in empty.schema
        ]
    )
    assert found(search(queries(spark, "document"), rows, now=NOW))["0"][0] == 99_999


# --- against a search that compares everything with everything ---------------------------------------


def grams(value):
    padded = f"  {value.lower()}  "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def slow_search(entries, query, profile, most, chosen="All"):
    """Ordered candidate ids of one query, written from the rules alone."""
    text = query.strip().lower()
    group = lambda e: "Setting" if e[1] == "Command" else e[1]
    terms = {e[0]: [t.lower() for t in [e[2], *e[8][3]]] for e in entries}
    held = {e[0]: set().union(*(grams(t) for t in terms[e[0]])) for e in entries}
    by_id = {e[0]: e for e in entries}
    apps = {t for e in entries if e[1] == "App" for t in terms[e[0]]}
    kinds = {e[8][0] for e in entries if e[1] == "File" and e[8][0]}
    words = profile.setting_words or {w for e in entries if e[1] == "Setting" for w in e[2].lower().split()}
    after = text.rpartition(".")[2] if "." in text else None
    inside = sorted(w for w in words if w in text)
    if text in apps:
        intent, keyword = "ExactApp", text
    elif after and after in kinds:
        intent, keyword = "FileExtension", after
    elif inside:
        intent, keyword = "Setting", inside[0]
    else:
        intent, keyword = "Mixed", None
    routes = parse_routes(profile.routes)[intent]
    scopes = [r[0] for r in routes]
    if profile.class_routes and chosen != "All":
        routes = parse_routes(profile.class_routes)[chosen]
    if profile.exact_scope == "filter":
        scopes = I.FILTER_CLASSES[chosen]
    accepted, hits = set(), defaultdict(int)
    for cls, source, least in routes:
        searched = keyword if source == "keyword" else text
        wanted = grams(searched)
        members = [e[0] for e in entries if group(e) == cls]
        scored = sorted((-(len(wanted & held[i]) / len(wanted)), i) for i in members)
        accepted |= {i for s, i in [x for x in scored if -x[0] >= least][:most]}
        counts = sorted((sum(g in held[i] for i in members), g) for g in wanted)
        for _, g in [c for c in counts if c[0] > 0][:3]:
            for i in members:
                hits[i] += g in held[i]
    for cls in scopes:
        owners = [e[0] for e in entries if group(e) == cls and text in {t.strip() for t in terms[e[0]]}]
        accepted |= set(owners[-1:])
    if len(text) < 15:
        pool = sorted((-n, i) for i, n in hits.items() if n)[:most]
        accepted |= {i for _, i in pool if any(edits(text, t) <= 2 for t in terms[i])}

    def quality(i):
        marks = {"prefix": (2, 1, 0), "contains": (3, 2, 1)}[profile.quality]
        return max(marks[0] if t == text else marks[1] if t.startswith(text) else marks[2] if text in t else 0 for t in terms[i])

    def usage(i):
        e = by_id[i]
        if not e[7]:
            return max(e[5], 0.0) if profile.zero_count_uses_score else 0.0
        return e[7] * 0.8 ** (max(0, NOW - e[6]) // 86400)

    name = (lambda n: n.upper()) if profile.name_order == "caseless" else (lambda n: n)
    ordered = sorted(accepted, key=lambda i: (-quality(i), -usage(i), name(by_id[i][2]), i))
    return ordered[: profile.stage1_limit or most]


@pytest.mark.parametrize("profile,chosen", [(UNIX, "All"), (WINDOWS, "All"), (WINDOWS, "Files")])
def test_same_candidates_as_comparing_everything(spark, profile, chosen):
    draw = random.Random(7)
    parts = ["net", "work", "Sound", "blue", "tooth", "doc", "note", "Box", "file", "é", "sys", "mon"]
    entries = []
    for i in range(1, 260):
        kind = draw.choice(["App", "File", "File", "Setting", "Command"])
        # A third of all entries are copies of one name.
        name = "copied name.txt" if i % 3 == 0 else "".join(draw.choices(parts, k=draw.randint(1, 3))) + draw.choice(["", " one", ".txt", ".pdf"])
        kind = "File" if i % 3 == 0 else kind
        ext = name.rpartition(".")[2] if kind == "File" and "." in name else None
        tags = draw.choices(["vc", "web browser", "Doc Tool", "tool"], k=draw.randint(0, 2)) if kind != "File" else []
        used = draw.random() < 0.3
        entries.append(entry(i, name, kind, tags=tags, file_type=ext, count=draw.randint(1, 9) if used else 0,
                             last=NOW - draw.randint(0, 10**6) if used else 0, score=draw.random() if draw.random() < 0.2 else 0.0))
    asked = sorted({e[2] for e in entries} | {e[2][:1] + e[2][2:] for e in entries} | {"web brwser", "x.txt", "copied nme.txt", "tool", "network sounds settings"})
    most = 12
    tables = LookupTables.of(catalog(spark, *entries), most, profile)
    want = {q.strip().lower(): slow_search(entries, q, profile, most, chosen) for q in asked}
    for broadcast in (True, False):
        stage1 = retrieve(
            queries(spark, *asked), tables, None, now=NOW, profile=profile, class_filter=chosen, broadcast=broadcast
        ).stage1
        got = defaultdict(list)
        for row in stage1.orderBy("text", "place").collect():
            got[row["text"]].append(row["id"])
        differing = {q: (ids, got.get(q, [])) for q, ids in want.items() if ids != got.get(q, [])}
        assert not differing


def test_hot_keys_are_spread_without_changing_results(spark, data, monkeypatch):
    from trigrove.operators import candidates as C
    from trigrove.plans.workload import prepared

    p = prepared(spark, data)
    few = p.queries.where("query_id like 'as is%'")
    key = ["query_id", "rank", "id"]
    plain = sorted(map(tuple, ranked_rows(few, p.tables, p.usage, now=NOW, broadcast=True).select(*key).collect()))
    monkeypatch.setattr(C, "MEETINGS_PER_SALT", 5)
    monkeypatch.setattr(C, "TEXTS_PER_SALT", 3)
    spread = sorted(map(tuple, ranked_rows(few, p.tables, p.usage, now=NOW, broadcast=False).select(*key).collect()))
    assert plain == spread and plain


def test_queries_under_one_id_are_ranked_apart(spark):
    entries = catalog(spark, *[entry(k, f"document {k}") for k in range(1, 15)], *[entry(k, f"picture {k}") for k in range(20, 33)])
    asked = spark.createDataFrame([("q", "document"), ("q", "picture"), ("q", "picture")], "query_id string, query string")
    rows = search(asked, entries, now=NOW).collect()
    ranks = {}
    for r in rows:
        ranks.setdefault(r["query"], []).append(r["rank"])
    assert sorted(ranks["document"]) == list(range(1, 11)) and sorted(ranks["picture"]) == sorted([*range(1, 11)] * 2)


def test_one_query_without_an_empty_one_skips_the_catalogs_best(spark):
    entries = catalog(spark, entry(1, "document", count=3, last=NOW))
    assert found(search(queries(spark, "documnt", "nothing like it"), entries, now=NOW)) == {"0": [1]}
    assert found(search(queries(spark, "documnt", " "), entries, now=NOW)) == {"0": [1], "1": [1]}


def test_stage_1_reads_few_rows_of_a_search_that_many_texts_share(spark):
    """Of the hits of a common search a text takes as many as stage 1 keeps, by its own match grade first."""
    from pyspark.sql import functions as F

    from trigrove.operators import candidates as C

    routes = spark.createDataFrame(
        [("n7", True, "File", "en", 0.6), ("name 31", True, "File", "en", 0.6)], "text string, single boolean, entry_class string, search_text string, least double"
    )
    found = spark.range(100).select(
        F.lit("File").alias("entry_class"), F.lit("en").alias("search_text"), F.lit(0.6).cast("double").alias("least"), F.lit("overlap").alias("role"), F.lit(1.0).alias("score"),
        "id", F.concat(F.lit("name "), "id").alias("name"), F.array(F.concat(F.lit("name "), "id")).alias("terms"),
        (F.col("id") % 3).alias("access_count"), F.lit(0).cast("long").alias("last_accessed"), F.lit(0.0).alias("frecency_score"),
    )
    rows = C.best_text_hits(routes, found, C.searches(routes), 5, "prefix", F.col("access_count").cast("double"), F.asc("name")).collect()
    ids = lambda t: sorted(r["id"] for r in rows if r["text"] == t)
    most_used = sorted((i for i in range(100) if i % 3 == 2), key=lambda i: f"name {i}")
    assert ids("n7") == sorted(most_used[:5]) and ids("name 31") == sorted([31, *[i for i in most_used if i != 31][:4]])


def test_meetings_without_a_grade_make_no_row(spark):
    """Shapes that share a gram with a search and cannot be among its hits are left out inside the join; the hits are those of comparing everything."""
    from trigrove.operators import candidates as C
    from trigrove.operators import index as X

    most, names = 5, [f"Supplier#{k * 7919 % 1_000_000:09d}" for k in range(400)] + [f"{k} words of a longer name that differs at its end only {k}" for k in range(20)]
    shapes = LookupTables.of(catalog(spark, *[entry(k, name, "App") for k, name in enumerate(names, 1)]), most)
    asked = [(t.lower(), len(t) < 15) for t in [*names[::7], *[n[:1] + n[2:] for n in names[3::9]], "123", "2340", "r#0"]]
    searches = spark.createDataFrame([("App", t, 0.8, near, 1) for t, near in asked], "entry_class string, search_text string, least double, near boolean, n_texts long")
    search_grams = C.ranked_grams(searches, shapes.gram_counts)
    lookups = C._lookups(search_grams)
    rows = C.met_by_gram(X.postings(C.signed(shapes.shapes), "grams", *C.SIGNATURE), lookups, most)
    meetings = lookups.where("search_text = 'r#0'").agg(F.sum("n_shapes")).first()[0]
    assert meetings >= 400 and rows.where("search_text = 'r#0'").count() < 200
    held = {k: grams(name) for k, name in enumerate(names, 1)}
    want = set()
    for t, near in asked:
        wanted = grams(t)
        overlaps = sorted((-len(wanted & g) / len(wanted), k) for k, g in held.items() if len(wanted & g) / len(wanted) >= 0.8 - 1e-9)
        want |= {(t, C.OVERLAP, k) for _, k in overlaps[:most]}
        rarest = [g for n, g in sorted((sum(g in h for h in held.values()), g) for g in wanted) if n][:3]
        pool = sorted((-sum(g in h for g in rarest), k) for k, h in held.items() if any(g in h for g in rarest))
        want |= {(t, C.FUZZY, k) for _, k in pool[:most]} if near else set()
    for broadcast in (True, False):
        assert {(r["search_text"], r["role"], r["id"]) for r in C.search_hits(shapes, search_grams, most, broadcast).collect()} == want
