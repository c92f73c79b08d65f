"""Near-duplicates, mixing, sharding and the pipeline."""

import math
import random

import brute
import numpy as np
import pytest
from comparing import compare, connection
from pyspark.sql import functions as F

import corpus_pipeline
from trigrove.llm import mixture, neardup, sharding
from trigrove.llm.components import components
from trigrove.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, width, percent):
    rows = brute.near_copies() + [(r[0], r[1]) for r in brute.awkward()]
    docs = brute.table(spark, [(*r, "en", "s") for r in rows])
    found = neardup.near_duplicates(docs, width=width, percent=percent).collect()
    wanted = brute.groups(rows, width, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"]) == sorted((i, *w) for (i, _), w in zip(rows, wanted, strict=True) if i)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)]


def test_blocks_of_a_long_list_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "ROWS_PER_CENTER", 2)
    base = brute.sentence(60, 7).split()
    rng = random.Random(4)
    rows = []
    for k in range(40):
        own = list(base)
        for _ in range(k % 6):
            own[rng.randrange(60)] = f"w{rng.randrange(4)}"
        rows.append((k + 1, " ".join(own)))
    found = neardup.near_duplicates(brute.table(spark, [(*r, "en", "s") for r in rows])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == [(i, *w) for (i, _), w in zip(rows, brute.groups(rows, 3, 85), strict=True)]


def test_large_sets_are_estimated_from_sketches(spark):
    """Sets beyond the sketch: a pair above, one below the threshold, and an unrelated text with a common passage."""
    words = brute.sentence(1500, 8, 5000).split()
    near, far = list(words), list(words)
    near[10:1400:60], far[10:1400:25] = ["n"] * len(near[10:1400:60]), ["f"] * len(far[10:1400:25])
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words[:300]) + " " + brute.sentence(1200, 9, 5000))]
    found = neardup.near_duplicates(brute.table(spark, [(*r, "en", "s") for r in rows])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(i, w[1]) for (i, _), w in zip(rows, brute.groups(rows, 3, 85), strict=True)]
    assert [r["component_id"] for r in sorted(found, key=lambda r: r["doc_id"])] == [1, 1, 3, 4]


def test_sure_runs():
    for percent in (80, 85, 90):
        long, short = neardup.run_lengths(percent)
        for u in range(1, 97):
            single = (100 - percent) * u // 100
            if single:
                cuts = [round((k + 1) * (u + 1) / (single + 1)) - 1 for k in range(single)]  # spread evenly: the worst case
                runs = [b - a - 1 for a, b in zip([-1, *cuts], [*cuts, u], strict=True)]
                assert max(runs) >= (short if u <= neardup.SHORT_SET else long)


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, None, "en", "s"), (4, "", "en", None), (4, "", "en", None), (5, "g", "en", "s")]
    docs = brute.table(spark, rows)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 4, 5]
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(200, 300), (300, 250), (250, 250)]
    rng.shuffle(links)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(2, 61)} == {1} and {found[k] for k in range(101, 140)} == {100} and found[300] == found[250] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def mixed_rows():
    rows = [(k, brute.sentence(1 + k % 7, k), "en", "big") for k in range(300)] + [(400 + k, brute.sentence(5, k), "en", f"s{k}") for k in range(4)]
    return rows + [(500, "x y z", "en", None), (501, None, "en", "big"), (501, None, "en", "big"), (None, "no id", "en", "s1")]


def test_targets_and_taken_words(spark):
    found = mixture.mixed(brute.table(spark, mixed_rows())).collect()
    assert len(found) == len(mixed_rows())
    total = sum(r["size"] for r in found)
    by_source = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    assert sum(rows[0]["target"] for rows in by_source.values()) == pytest.approx(total)
    weights = dict(zip([*sorted(s for s in by_source if s), None], [5, 2, 1] * 3, strict=False))
    level = {rows[0]["target"] / weights[s] for s, rows in by_source.items() if rows[0]["target"] < 3 * rows[0]["source_size"]}
    assert max(level) - min(level) < 1e-9
    for s, rows in by_source.items():
        assert rows[0]["target"] <= min(3 * rows[0]["source_size"], max(level) * weights[s]) + 1e-9
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2 + 1e-9


def test_copies_come_in_the_order_of_the_inverted_demand(spark):
    docs = brute.table(spark, mixed_rows())
    taken = mixture.mixed(docs).agg(F.sum("copies")).first()[0]
    copies = mixture.curriculum(docs)
    assert copies.columns == docs.columns and copies.count() == taken
    for mean, ramp in mixture.CYCLE:
        target = 700.0
        for t in (0.0, 0.1, 0.5, 1.0):
            demand = target * (t + ramp * (t * t - t))  # the integral of mean * (1 - ramp + 2 * ramp * t), as a share
            found = spark.range(1).select(mixture._position(F.lit(demand), F.lit(target), F.lit(float(ramp)))).first()[0]
            assert found == pytest.approx(t, abs=1e-9), mean
    assert mixture.mixed(docs.limit(0)).count() == 0 and mixture.curriculum(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n, rows_per_cell", [(0, 8), (5, 8), (700, 8), (700, 1 << 15)])
def test_shards_are_exact_and_slots_without_gap(spark, n, rows_per_cell):
    rows = [(k % 350, None if k % 100 == 0 else f"t{k % 350}", "en", "s") for k in range(n)]
    found = sharding.sharded(brute.table(spark, rows), rows_per_cell=rows_per_cell)
    again = sharding.sharded(brute.table(spark, rows[::-1]), rows_per_cell=rows_per_cell)
    place = lambda df: sorted((r["shard"], r["slot"], r["doc_id"], r["text"] or "", r["size"], r["text_crc32"]) for r in df.collect())
    rows_found = place(found)
    assert rows_found == place(again) and len(rows_found) == n
    for s in range(16):
        slots = [r[1] for r in rows_found if r[0] == s]
        assert slots == list(range(n // 16 + (s < n % 16)))
    import zlib

    assert all(r[4] == len(r[3]) + 1 and r[5] == zlib.crc32(r[3].encode()) for r in rows_found)


def test_matrix_rows_and_columns_have_their_sums(spark):
    counts = spark.createDataFrame([(0, 50), (2, 7), (3, 143), (6, 1), (7, 30)], "part long, n long")
    cells = [60, 0, 100, 1, 70]
    found = {r["part"]: r["row"] for r in sharding.matrix(counts, 8, cells).collect()}
    assert [sum(found[p]) for p in range(8)] == [50, 0, 7, 143, 0, 0, 1, 30]
    assert [sum(found[p][c] for p in range(8)) for c in range(5)] == cells
    assert min(min(r) for r in found.values()) >= 0


def test_draws_are_hypergeometric(spark):
    n = 20_000
    drawn = spark.range(n).select(sharding.hypergeometric(F.lit(100), F.lit(30), F.lit(40), sharding._uniform(F.lit(5), F.col("id"))).alias("x"))
    counts = {r["x"]: r["count"] for r in drawn.groupBy("x").count().collect()}
    for x in range(31):
        wanted = n * math.comb(30, x) * math.comb(70, 40 - x) / math.comb(100, 40)
        assert abs(counts.get(x, 0) - wanted) <= 5 * math.sqrt(wanted) + 3
    sure = [(10, 0, 5, 0), (10, 10, 5, 5), (10, 4, 10, 4), (10, 4, 0, 0), (0, 0, 0, 0), (7, 5, 6, None)]
    for total, good, draws, wanted in sure:
        x = spark.range(50).select(sharding.hypergeometric(F.lit(total), F.lit(good), F.lit(draws), sharding._uniform(F.lit(1), F.col("id"))).alias("x")).distinct().collect()
        assert {r["x"] for r in x} == ({4, 5} if wanted is None else {wanted})


def test_stages_over_a_small_table(spark, data):
    """Each stage on what the one before kept, against brute force."""
    docs, name = spark.read.parquet(f"{data}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert name == ["quality rules", "near-duplicates", "decontamination", "mixture", "sharding"]
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    given = {r["doc_id"]: r["text"] for r in docs.collect()}

    ruled = stage["quality rules"](spark, docs, data)
    verdicts = {r["doc_id"]: r["kept"] for r in QUERIES["op4_quality"](spark, data).collect()}
    assert ruled.columns == docs.columns and rows(ruled) == sorted((i, t) for i, t in given.items() if verdicts[i])

    single = stage["near-duplicates"](spark, ruled, data)
    before = rows(ruled)
    assert single.columns == docs.columns
    assert rows(single) == [r for r, w in zip(before, brute.groups(before, 5, 80), strict=True) if w[1] == r[0]]

    clean = stage["decontamination"](spark, single, data)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = rows(single)
    found = brute.contamination([t for _, t in before], items)
    assert clean.columns == docs.columns
    assert rows(clean) == [r for r, (n, hit, _) in zip(before, found, strict=True) if not hit or 20 * len(hit) < n]

    mix = stage["mixture"](spark, clean, data)
    con = connection(data)
    held = clean.toPandas()
    con.execute("drop view documents")
    con.register("documents", held)
    assert mix.columns == docs.columns
    assert compare(mixture.mixed(clean, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("first_position", 9).alias("first_position")), con, SQL["op2_mix_sources"]) == []
    copies = dict(con.execute(f"select doc_id, copies from ({SQL['op2_mix_sources']})").fetchall())
    taken = rows(mix)
    assert taken == sorted((i, given[i]) for i, n in copies.items() for _ in range(n))

    final = stage["sharding"](spark, mix, data).collect()
    assert sorted((r["doc_id"], r["text"]) for r in final) == taken
    for s in range(16):
        assert sorted(r["slot"] for r in final if r["shard"] == s) == list(range(len(taken) // 16 + (s < len(taken) % 16)))


def test_sets_of_up_to_150_shingles_enter_every_run():
    values = 2 * np.arange(150, dtype=np.uint64) + np.uint64(1)  # none is divisible by four
    lengths = neardup.run_lengths(85)
    assert lengths[0] == 5
    for n in (97, 110, 129, 150):
        assert len(neardup._runs(values[:n], n, lengths)) == n - 4
        one, other = values[:n], np.delete(values[:n], np.arange(3, n, 6)[: 15 * n // 100])
        assert np.intersect1d(neardup._runs(one, n, lengths), neardup._runs(other, len(other), lengths)).size
