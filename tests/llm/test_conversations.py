"""Conversation repair against a search over all cheapest edits in plain Python."""

import hashlib
import random
import zlib

import pytest
from comparing import compare, connection
from pyspark.sql import functions as F

from trigrove.llm import conversations
from trigrove.llm.queries import QUERIES, SQL

SPACE = " \t\n\v\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
OTHER = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def repair(rows):
    """(counts, audit, repaired lines) of (turn, role, text) rows in order: least (cost, audit) by state, from the first row on."""
    seen, marks = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        marks.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                one = (cost + 2, audit + "I", lines + (f"{FULL[OTHER[q]]}:",))
                if OTHER[q] not in best or one[:2] < best[OTHER[q]][:2]:
                    best[OTHER[q]] = one
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), mark in zip(rows, marks, strict=True):
        step = {}
        for q, (cost, audit, lines) in best.items():
            options = [(q, cost + 3, audit + "D", lines)]
            if mark in ("", "truncated"):
                more = mark == "truncated"
                if (q, role[:1]) in NEXT:
                    options.append((NEXT[q, role[:1]], cost + more, audit + "K", (*lines, f"{role}:{text}")))
                options.append((OTHER[q], cost + 2 + more, audit + "R", (*lines, f"{FULL[OTHER[q]]}:{text}")))
            for to, *rest in options:
                if to not in step or tuple(rest[:2]) < step[to][:2]:
                    step[to] = tuple(rest)
        best = inserted(step)
    cost, audit, lines = min(best[q] for q in ("", "a") if q in best)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return [gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), pairs, cost], audit, lines


def by_conversation(rows):
    found = {}
    for c, t, r, x in rows:
        r, x = r or " " if r != "" else "", " " if x is None else x
        found.setdefault(c, []).append((t, r, x))
    for held in found.values():
        held.sort(key=lambda k: (k[0] is not None, k[0] or 0, k[1], hashlib.sha256(k[2].encode()).digest()))
    return found


def expected(rows):
    out = {}
    for c, held in by_conversation(rows).items():
        counts, audit, lines = repair(held)
        out[c] = (*counts, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(seed, n_conversations=60):
    rng, rows = random.Random(seed), []
    for c in range(n_conversations):
        n = rng.choice([1, 2, 3, 5, 8, 13, 30])
        for k in range(n):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "User", None])
            text = rng.choice([f"word {rng.randrange(4)}.", f"own {k}.", f"own {k}!", "cut off", f"cut {k}", "", " \n\t", None, "é漢?\x0b "])
            rows.append((c if c else None, rng.choice([k, k, k, k + 1, None]), role, text))
    return rows


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"edit": F.lit("x"), "c": F.lit(7), "a.b": F.lit("kept")})
    found, counted = conversations.repaired(df, **options)
    digest = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in conversations.digest(found).collect()}
    counts = {r["conv_id"]: tuple(r[c] for c in conversations.COUNTS) for r in counted.collect()}
    assert digest.keys() == counts.keys()
    return {c: (*counts[c], *digest[c]) for c in digest}, found


@pytest.mark.parametrize("chunk_rows", [1, 3, 1 << 16])
def test_cheapest_repairs_with_least_letters(spark, chunk_rows):
    rows = some_rows(chunk_rows)
    found, repaired = result(spark, rows, chunk_rows=chunk_rows)
    assert found == expected(rows)
    lines = repaired.select("conv_id", "turn", "`a.b`", "c", "edit", "new_role", "new_text").collect()
    assert sum(r["edit"] != "I" for r in lines) == len(rows)
    assert all((r["a.b"], r["c"]) == ((None, None) if r["edit"] == "I" else ("kept", 7)) for r in lines)


def test_one_conversation_over_all_partitions(spark):
    rng = random.Random(8)
    rows = [(5, k, rng.choice(["user", "assistant", "assistant"]), f"text {rng.randrange(3000)}{rng.choice(['.', '.', ''])}") for k in range(4000)]
    assert result(spark, rows, chunk_rows=50)[0] == expected(rows)


def test_long_runs_and_equal_rows(spark):
    rows = [(1, k, "user", f"{k}.") for k in range(1000)] + [(2, 1, "user", "same.")] * 500 + [(3, None, "assistant", "Hello!")] * 3 + [(4, 9, "system", "only.")]
    found, _ = result(spark, rows)
    assert found == expected(rows)
    assert found[2][:6] == (0, 0, 499, 0, 499, 499 * 3 + 2) and found[4][6] == "D"


def test_powers_are_repeated_steps():
    for symbol in range(16):
        v = w = conversations.LAST
        for n in range(1, 40):
            w = conversations.before(conversations.power(symbol, 0), w)
            assert conversations.run_before(symbol, n, v) == w


def test_nothing(spark):
    found, counted = conversations.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.count() == 0 and counted.count() == 0 and conversations.digest(found).count() == 0


def damage(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 1:
            x = ""
        if kind == 2:
            x = x.translate({ord(k): None for k in ".!?"})
        if kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_query_is_that_of_the_search(spark, tmp_path):
    rows = some_rows(77, 300)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    wanted = expected(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        assert tuple(r)[1:] == wanted.get(r["conv_id"], nothing)


def test_query_is_that_of_its_sql(spark, data):
    name = "op11_conversation_repair"
    assert compare(QUERIES[name](spark, data), connection(data), SQL[name]) == []
