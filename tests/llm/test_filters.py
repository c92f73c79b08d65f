"""Decontamination, quality rules, line dedup and URL filters."""

import hashlib
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from comparing import compare, connection

from trigrove.llm import decontaminate, lines, quality, urls
from trigrove.llm.queries import QUERIES, SQL

ITEMS = [(1, brute.sentence(20, 50)), (2, "five Words are one window"), (2, brute.sentence(13, 51)), (3, None), (4, "..."), (None, brute.sentence(14, 52)), (5, brute.sentence(20, 50))]


def contaminated_rows():
    inside = brute.sentence(40, 60)
    rows = [(20 + k, f"{inside} {t.upper() if k % 2 else t}, {inside}", "en", "s1") for k, (_, t) in enumerate(ITEMS) if t]
    rows.append((40, brute.sentence(20, 50).rsplit(" ", 8)[0] + " other", "en", "s1"))
    rows.append((41, f"{brute.sentence(13, 51)} {brute.sentence(14, 52)} É", "en", "s1"))
    return brute.awkward() + rows + rows[:2]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_contamination_is_that_of_every_window(spark, block_bytes):
    rows = contaminated_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = brute.table(spark, rows)
    found = decontaminate.digest(decontaminate.contamination(docs, items, block_bytes=block_bytes)).collect()
    assert "a.b" in found[0].asDict() and len(found) == len(rows)
    wanted = brute.contamination([r[1] for r in rows], ITEMS)
    by_text = {r[1]: w for r, w in zip(rows, wanted, strict=True)}
    for r in found:
        n, hit, names = by_text[r["text"]]
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, len(hit), len(names), digest)
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= n)
        assert {k for s in r["hit_words"] for k in range(s["start"], s["end"])} == hit
        cut = " ".join(r["text"][s["start"] : s["end"]] for s in r["hit_spans"])
        assert len(brute.ALPHANUMERIC.findall(brute.lower(cut))) == len(hit)


def test_spans_are_cut_out(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([("É x a B c, y a b c",), ("nothing",), (None,)], "text string")
    found = decontaminate.contamination(docs, items)
    kept = found.select(decontaminate.without_spans(found["text"], found["hit_spans"]).alias("t")).collect()
    assert [r["t"] for r in kept] == ["É x , y ", "nothing", None]


def test_empty_tables(spark):
    docs, items = brute.table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == 0
    assert decontaminate.contamination(brute.table(spark, brute.awkward()), items).where("size(items) > 0").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, quality.trusted(labels)).count() == 0
    assert lines.without_boilerplate(docs).count() == 0


def test_quality_counts_and_verdicts(spark, data):
    rows = brute.awkward() + [(50 + k, t, "en", "s1") for k, t in enumerate(["a b c d e " * 5 + "f", "x\ny\nx\n\n \nx", "a a a a a a", "a|b #c\n" * 3, "u " * 9])]
    docs = brute.table(spark, rows)
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.judged(docs, quality.trusted(labels)).collect()
    assert len(found) == len(rows)
    for r in found:
        wanted = brute.measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted
        assert r["base_failed"] == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, quality.trusted(none)).where("score <> 0").count() == 0


def test_scores_are_mean_log_ratios_over_all_documents(spark):
    """Against counts in plain Python, with the tokens cut by a regular expression."""
    rows = [(k, brute.sentence(30 + k, k, 30) + " !!! ***", "en", "s") for k in range(20)]
    trusted = spark.createDataFrame([(k,) for k in range(8)], "doc_id long")
    found = {r["doc_id"]: r["score"] for r in quality.judged(brute.table(spark, rows), trusted).collect()}

    def grams(text):
        tokens = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^\s0-9a-z\x80-\U0010ffff]+", brute.lower(text))
        return [(t,) for t in tokens] + list(zip(tokens, tokens[1:], strict=False))

    buckets = {}
    for _, text, _, _ in rows:
        data, offsets = quality.W.utf8(pa.array([text]))
        ones, _, pairs, _ = quality._grams(data, offsets)
        for g, b in zip(grams(text), [*ones.tolist(), *pairs.tolist()], strict=True):
            assert buckets.setdefault(g, b) == b
    raw, good = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for k, text, _, _ in rows:
        for g in grams(text):
            raw[buckets[g]] += 1
            good[buckets[g]] += k < 8
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for k, text, _, _ in rows:
        assert found[k] == pytest.approx(np.mean([ratio[buckets[g]] for g in grams(text)]))


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_mix_sources", "op3_near_duplicates", "op6_line_dedup", "op10_url_filter"])
def test_same_as_sql(spark, data, name):
    assert compare(QUERIES[name](spark, data), connection(data), SQL[name]) == []


def test_quality_counts_every_trusted_text_both_ways(spark, monkeypatch):
    rows = [(k, f"word{k % 7} other{k % 5} thing{k}") for k in range(60)] + [(3, "again"), (None, "no id")]
    docs, good = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in range(0, 60, 2)] + [(None,), (2,)], "doc_id long")
    sent = quality.log_ratios(docs, good, buckets=512)
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    joined = quality.log_ratios(docs, good, buckets=512)
    assert (sent == joined).all() and len(sent) == 512
    counts = quality._marked(docs, good, "doc_id", "text").groupBy("_trusted").count().collect()
    assert {r["_trusted"]: r["count"] for r in counts} == {True: 30, False: 32}


def test_quality_scores_do_not_depend_on_neighbours():
    values = quality.np.random.default_rng(1).normal(size=1_000)
    together = quality._own_sums(values, quality.np.array([0, 0, 333, 333, 1_000, 1_000]))
    alone = [quality._own_sums(part, quality.np.array([0, len(part)]))[0] for part in (values[:333], values[333:])]
    assert together.tolist() == [0, alone[0], 0, alone[1], 0]


def test_quality_query_keeps_good_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op4_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = found.where("quality = 1"), found.where("quality = 0")
    assert good.where("not kept").count() == 0
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_lines_on_many_sites_go(spark):
    rows = [(k, f"own {k}\n  shared \n\nfew\nown {k}", "en", f"s{k % 40}") for k in range(200)]
    rows += [(300 + k, f"few sites\nrepeated\nrepeated {k}", "en", f"s{k % 4}") for k in range(40)]
    rows += [(400 + k, "exactly five", "en", None if k == 4 else f"s{k}") for k in range(5)] + [(500, None, "en", "s1"), (501, "", None, None), (502, "shared", "en", "s1"), (502, "shared", "en", "s1")]
    found = {r["doc_id"]: r for r in lines.without_boilerplate(brute.table(spark, rows)).collect()}
    assert found[3]["clean_text"] == "own 3\n\nown 3" and (found[3]["n_lines"], found[3]["n_removed"]) == (4, 2)
    assert found[310]["clean_text"] == rows[210][1] and found[310]["n_removed"] == 0
    assert found[402]["clean_text"] == "" and found[502]["n_removed"] == 1
    assert (found[500]["clean_text"], found[500]["n_lines"], found[501]["clean_text"]) == (None, 0, "")


def _glob(text):
    host, slash, path = text.partition("/")
    piece = lambda s: "".join({"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, re.escape(c)) for c in s)
    return re.compile(f"{'' if host.startswith('*') else re.escape('.')}{piece(host)}\x00{piece(slash + path)}")


def test_automaton_fits_what_globs_fit():
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    globs = [f"{word('ab.*?', 5)}/{word('ab.*?/', 5)}" for _ in range(60)]
    texts = [(word("ab.", 7), rng.choice(["", "/"]) + word("ab./", 7)) for _ in range(2000)]
    matches = urls._matching(urls.Automaton([urls.Pattern.glob(g) for g in globs]))
    found = matches(pa.array([h for h, _ in texts]), pa.array([p for _, p in texts]))
    assert sum(len(urls.Pattern.glob(g).symbols) for g in globs) > 128  # more than two words of states
    wanted = [[bool(_glob(g).fullmatch(f".{h}\x00{p}")) for g in globs] for h, p in texts]
    assert (found == np.array(wanted)).all()


def test_addresses(spark):
    rows = [
        "https://A.Example.ORG/en/12?x", "http://example.org/en/2", "http://example.org", "http://notexample.org.com/fr/", "x://com/de/a#b", None, "no address", "", "a://b://c/d",
        "http://www.cheap-pills.example.com/fr/1", "http://www.cheap-pills.example.com/en/1", f"http://h.net/{'a' * 50_000}.exe", "http://ünï.net/é.exe",
    ]
    pages = spark.createDataFrame([(u, "r") for u in rows], "url string, rule string")
    found = [(r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in urls.judged(pages).collect()]
    assert found == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("example.org", "", None, "allow"),
        ("notexample.org.com", "/fr/", "com/fr/", "allow"), ("com", "/de/a", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("b:", "//c/d", None, "allow"), ("www.cheap-pills.example.com", "/fr/1", "com/fr/", "allow"), ("www.cheap-pills.example.com", "/en/1", None, "block"),
        ("h.net", "/aaaaaaaa", None, "block"), ("ünï.net", "/é.exe", None, "block"),
    ]
    assert urls.judged(pages.limit(0)).count() == 0
