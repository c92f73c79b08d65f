"""Plain Python answers to compare with, and small tables with awkward rows."""

from __future__ import annotations

import collections
import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, score string, size string, "
    "spans string, shard string, items string, `a.b` string"
)
#: Names that operators use within, or could; a column of such a name is a column like others.
WITHIN = ("mark", "_mark", "_part", "_rank", "_text", "_removed", "_source", "_items", "_blank", "_url", "_doc", "_cell", "_block", "_start", "split", "_id")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names the operators use too."""
    columns = ", ".join([COLUMNS, *(f"{c} string" for c in WITHIN)])
    return spark.createDataFrame([(*r, len(r[1] or ""), *("x",) * 8, *(f"{c} of {r[0]}" for c in WITHIN)) for r in rows], columns)


def keeps_columns(found, but=()):
    """Every row of ``found`` has the values of ``table`` in the columns that operators use within."""
    rows = found.collect()
    return bool(rows) and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in WITHIN if c not in but)


def sentence(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    long = sentence(30_000, 1, 5000)
    return [
        (1, None, "en", "s1"), (2, "", "en", None), (3, "   \n\t ", None, "s1"), (4, "one", "de", "s2"), (5, "two words", "de", "s2"),
        (6, long, "fr", "s3"), (7, long, "fr", "s3"), (7, long, "fr", "s3"), (None, "lost its id but has some words in it all the same", "en", "s1"),
        (8, "É漢字 ñ\x00x ÇA", "es", None), (9, "###$$$ !!! ...", "en", "s4"), (-3, "Same Text here", "en", "s1"), (10, "same text HERE", "en", "s2"),
    ]


def contamination(docs, items, width=13):
    """{position: (n_words, hit word numbers, item ids)} by looking every window up."""
    windows = collections.defaultdict(set)
    for name, text in items:
        words = ALPHANUMERIC.findall(lower(text))
        for k in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[k : k + width])] |= {str(name)} if name is not None else set()
    found = []
    for text in docs:
        words = ALPHANUMERIC.findall(lower(text))
        hit, names = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(words[k : k + n])]
        found.append((len(words), hit, sorted(names)))
    return found


def shingles(text, width):
    words = SPACED.findall(lower(text))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def groups(rows, width, percent):
    """[(set size, smallest id of the group)] of (id, text) rows; every pair that shares a shingle is compared."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, own in enumerate(sets):
        met = collections.Counter(j for s in own for j in held[s])
        for j, both in met.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for s in own:
            held[s].append(i)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(len(s), rows[i][0] if not s else least.get(find(i))) for i, s in enumerate(sets)]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if counts[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def near_copies(n_bases=12, copies=6, seed=5):
    """Texts of 3 to 300 words with copies that differ in a few words, some of them near the threshold."""
    rng = random.Random(seed)
    rows, name = [], 100
    for b in range(n_bases):
        words = sentence(rng.choice([3, 4, 6, 7, 9, 15, 17, 25, 40, 90, 120, 300]), 1000 + b).split()
        for c in range(copies):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(own) // 40), max(1, len(own) // 25)])):
                own[rng.randrange(len(own))] = f"new{rng.randrange(3)}"
            if rng.random() < 0.3:
                own.append("tail")
            rows.append((name, " ".join(own)))
            name += rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows
