"""Importance resampling against counts of n-grams in plain Python."""

import collections
import hashlib
import math
import random
import zlib

import brute
import numpy as np
from comparing import compare, connection

from trigrove.llm import importance
from trigrove.llm.queries import QUERIES, SQL


def grams(text):
    words = brute.ALPHANUMERIC.findall(brute.lower(text))
    return len(words), [" ".join(words[k : k + n]) for k in range(len(words)) for n in (1, 2, 3) if k + n <= len(words)]


def drawn(rows, targets, percent=5):
    """[(n_words, n_features, weight, score)] of (id, text) rows, and the places drawn, best first."""
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    held = [(n, [bucket(g) for g in found]) for n, found in (grams(t) for _, t in rows)]
    raw = collections.Counter(b for _, bs in held for b in bs)
    aim = collections.Counter(bucket(g) for t in targets for g in grams(t)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000)))) for b in raw}
    out = []
    for (name, _), (n, bs) in zip(rows, held, strict=True):
        h = int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append((n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((i for i, o in enumerate(out) if o[0] >= 20), key=lambda i: (-out[i][3], rows[i][0] is None, rows[i][0] or 0))
    return out, able[: len(able) * percent // 100]


def test_crcs_are_those_of_every_run_of_words():
    rng = random.Random(4)
    texts = ["", "one", "ONE two", "  a-b_c  ", "ü漢字, É!! x\x00y", "q" * 64 + " r " + "s" * 65 + " t u " + "v" * 900 + " w", brute.sentence(70_000, 3)]
    texts += [" ".join("".join(rng.choice("abcXYZ019é") for _ in range(rng.randrange(1, 70))) for _ in range(rng.randrange(9))) for _ in range(200)]
    n_words, crcs, owner = importance.gram_crcs([t.encode() for t in texts])
    for i, text in enumerate(texts):
        n, wanted = grams(text)
        assert n == n_words[i] and collections.Counter(crcs[owner == i].tolist()) == collections.Counter(zlib.crc32(g.encode()) for g in wanted)
        buckets = np.sort(crcs[owner == i] % 10_000)
        assert importance.unpacked(importance.packed(buckets)).tolist() == buckets.tolist()


def test_draw_is_that_of_plain_counts(spark):
    targets = [(1, brute.sentence(50, 900)), (2, None), (3, "Straße und Wörter"), (3, "Straße und Wörter")]
    rows = brute.awkward() + [(100 + k, brute.sentence(10 + k % 40, k) + (" " + targets[0][1] if k % 9 == 0 else ""), "en", "s1") for k in range(300)]
    rows += rows[-5:]
    docs, items = brute.table(spark, rows).withColumnsRenamed({"kept": "rank", "size": "weight"}), spark.createDataFrame(targets, "item_id long, text string")
    found = importance.resampled(docs, items).collect()
    wanted, places = drawn([r[:2] for r in rows], [t for _, t in targets])
    assert "a.b" in found[0].asDict()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_features"], r["weight"], r["score"]) for r in found) == sorted((repr(r[0]), *w) for r, w in zip(rows, wanted, strict=True))
    ranked = sorted((r["rank"], r["doc_id"], r["score"]) for r in found if r["rank"] is not None)
    assert ranked == [(k + 1, rows[i][0], wanted[i][3]) for k, i in enumerate(places)]
    assert all(r["doc_id"] is None or r["text"] == dict(x[:2] for x in rows)[r["doc_id"]] for r in found)


def test_ranks_with_many_equal_scores(spark):
    rows = [(7, "the same words again and again " * 5)] * 400 + [(k, brute.sentence(30, k)) for k in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = importance.resampled(docs, docs.limit(0), percent=90).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 451))


def test_nothing(spark):
    docs, items = brute.table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(docs, items).count() == 0


def test_query_is_that_of_its_sql(spark, data):
    assert compare(QUERIES["op13_importance"](spark, data), connection(data), SQL["op13_importance"]) == []
