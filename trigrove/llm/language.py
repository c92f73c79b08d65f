"""Language of a text, in two steps: the family first, then the languages within it.

A text is the relative frequencies of its hashed byte pairs and triples (letters only, A-Z in lower case). Linear
support vector machines, one for each family against the others, choose the family; within it one machine for each
pair of languages separates the close ones, and the language with most won pairs (then the largest margins) is taken.

The machines are fitted on at most ``PER_LANGUAGE`` documents of each language (the smallest by a hash of id and
text), whose features, not texts, go to the driver. Every document is predicted whole, in its own task, without shuffle.

Defined results: a null text or one without any letter is ``und`` with score 0, as is every text if nothing could be
learned; with one family or one language there is nothing to separate and its part of the score is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrove.llm import words as W
from trigrove.llm.batches import add_columns, named, remainder

PER_LANGUAGE = 400
BUCKETS = 1 << 13
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code, fixed facts. A code that is not here is in a family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru uk be pl cs sk bg mk sr hr sl bs",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "baltic": "lt lv", "celtic": "ga gd cy br", "greek": "el", "semitic": "ar he mt am",
    "indo-aryan": "hi bn ur mr pa gu ne si", "dravidian": "ta te kn ml", "sino-tibetan": "zh my bo", "japonic": "ja", "koreanic": "ko",
    "austronesian": "id ms tl jv mg", "austroasiatic": "vi km",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Bytes that are kept; all others stand for the space between words.
_LETTERS = np.full(256, 0x20, np.uint8)
for _b in (*range(0x61, 0x7B), *range(0x80, 0x100)):
    _LETTERS[_b] = _b
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte pairs and triples at each byte, and which of the positions are inside a text and hold a letter."""
    part = _LETTERS[data[offsets[0] : offsets[-1]]].astype(np.uint32)
    n = len(part)
    padded = np.concatenate([np.full(1, 0x20, np.uint32), part, np.full(1, 0x20, np.uint32)])
    at = (offsets - offsets[0])[:-1]
    left, right = padded[:-2].copy(), padded[2:].copy()
    left[at[at < n]] = 0x20
    last = (offsets - offsets[0])[1:] - 1
    right[last[last >= 0]] = 0x20
    pair = (left * np.uint32(0x9E3779B1)) ^ (part * np.uint32(0x85EBCA6B))
    triple = pair ^ (right * np.uint32(0xC2B2AE35)) ^ np.uint32(0x27D4EB2F)
    spread = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)
    letter = part != 0x20
    return np.stack([spread(pair), spread(triple)]), letter


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in a text and their relative frequencies."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    grams, letter = _grams(data, np.array([0, len(data)]))
    bucket, count = np.unique(grams[:, letter], return_counts=True)
    return bucket, count / max(1, count.sum())


def fitted_machine(x: np.ndarray, y: np.ndarray, rounds: int = 200, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by accelerated gradient steps; both classes weigh alike. ``y`` is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    step = 1 / (2 * float((weight * (np.square(x).sum(1) + 1)).sum()) + penalty)
    w = look = np.zeros(x.shape[1], x.dtype)
    b = look_b = 0.0
    for k in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ look + look_b)) * weight * y
        new, new_b = look + step * (2 * (x.T @ miss) - penalty * look), look_b + step * 2 * miss.sum()
        pull = k / (k + 3)
        look, look_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, float(b)


class Hierarchy:
    """Machines as the columns of one weight table: families first, then pairs of languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        labels = np.array(languages, object)
        self.languages = sorted(set(languages))
        family = {c: FAMILY_OF.get(c.lower(), "other") for c in self.languages}
        self.families = sorted(set(family.values()))
        self.within = {f: [c for c in self.languages if family[c] == f] for f in self.families}
        self.pairs = [(a, b) for own in self.within.values() for i, a in enumerate(own) for b in own[i + 1 :]]
        scale = 1 / np.maximum(np.sqrt(np.square(x).mean(0)), 1e-4) if len(x) else np.ones(BUCKETS)
        scaled = (x * scale).astype(np.float32)
        scaled_by = np.sqrt(np.square(scaled).sum(1).mean()) if len(x) else 1.0
        scaled /= scaled_by
        columns, self.bias = [], []
        of = np.array([family[c] for c in languages], object)
        tasks = [(np.ones(len(labels), bool), of == f) for f in self.families] if len(self.families) > 1 else []
        tasks += [((labels == a) | (labels == b), labels == a) for a, b in self.pairs]
        for chosen, positive in tasks:
            w, b = fitted_machine(scaled[chosen], np.where(positive[chosen], 1.0, -1.0).astype(np.float32))
            columns.append(w * scale / scaled_by)
            self.bias.append(b)
        self.table = np.column_stack(columns) if columns else np.zeros((BUCKETS, 0))

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        n = len(self.families) if len(self.families) > 1 else 0
        k = int(np.argmax(margins[:n])) if n else 0
        sure = float(sigmoid(margins[k])) if n else 1.0
        own = self.within[self.families[k]]
        won, total, least = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0), dict.fromkeys(own, 1.0)
        for (a, b), m in zip(self.pairs, margins[n:].tolist(), strict=True):
            if a in won:
                won[a if m >= 0 else b] += 1
                for c, s in ((a, m), (b, -m)):
                    total[c] += s
                    least[c] = min(least[c], float(sigmoid(s)))
        best = max(own, key=lambda c: (won[c], total[c], c))
        return best, sure * least[best]


def _has_letter(data: np.ndarray) -> bool:
    lower = data | 0x20
    if ((lower >= 0x61) & (lower <= 0x7A)).any():
        return True
    return bool((data >= 0x80).any()) and any(c.isalpha() for c in bytes(data).decode("utf-8", "replace"))


def _predicting(model: Hierarchy):
    table = model.table.astype(np.float32)
    bias = np.array(model.bias)

    def compute(texts: pa.Array) -> list[pa.Array]:
        data, offsets = W.utf8(texts)
        names, scores = [], []
        for a, b in W.slices(offsets):
            grams, letter = _grams(data, offsets[a : b + 1])
            at = offsets[a : b + 1] - offsets[a]
            counted = np.concatenate([[0], np.cumsum(letter)])
            n = 2 * (counted[at[1:]] - counted[at[:-1]])
            kept = grams[:, letter]
            edges = counted[at]
            margins = np.empty((b - a, table.shape[1]))
            for k in range(table.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(table[kept[0], k].astype(float) + table[kept[1], k])])
                margins[:, k] = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(n, 1) + bias[k]
            for i in range(b - a):
                if not model.languages or not _has_letter(data[offsets[a + i] : offsets[a + i + 1]]):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    name, score = model.decide(margins[i])
                    names.append(name)
                    scores.append(score)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return compute


def _featuring():
    def compute(texts: pa.Array) -> list[pa.Array]:
        found = [frequencies(t.as_py() or "") for t in texts]
        return [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]

    return compute


def learned(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy:
    """Machines from (id, text, lang)."""
    usable = rows.where("lang is not null and text is not null and text <> ''").withColumn("order", F.xxhash64("id", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id"))
    picked = usable.select("lang", "order", "id").withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "order").distinct()
    sample = usable.join(F.broadcast(picked), ["lang", "order"]).select("lang", "text")
    features = add_columns(sample, [F.col("text")], "buckets array<long>, parts array<double>", _featuring, ["lang"]).collect()
    features = sorted(features, key=lambda r: (r["lang"], r["buckets"], r["parts"]))
    x = np.zeros((len(features), BUCKETS))
    for i, row in enumerate(features):
        x[i, row["buckets"]] = row["parts"]
    return Hierarchy(x, [row["lang"] for row in features])


def predicted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` with ``held_out``, ``lang_pred`` and ``score``; learns from rows that are not held out."""
    held_out = remainder(named(doc_id), 4) == 2
    rows = docs.where(~held_out).select(named(doc_id).alias("id"), named(text).cast("string").alias("text"), named(lang).cast("string").alias("lang"))
    model = learned(rows)
    return add_columns(
        docs.withColumn("held_out", held_out), [named(text).cast("string")], "lang_pred string, score double", lambda: _predicting(model),
        None if keep is None else [*keep, "held_out"],
    )
