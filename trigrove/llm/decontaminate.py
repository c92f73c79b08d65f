"""Benchmark decontamination: phrases of test items are looked up in an FM-index of each training shard.

A shard is a run of texts within a task. Words that no phrase holds cannot be part of an occurrence, so
they end a sequence, and sequences shorter than the shortest phrase are not indexed: this leaves the
result as it is and most of the words out. Phrases are looked up by backward search through wavelet-tree
ranks, located by sampled suffix positions, and their places merged to spans to remove.

Texts are read once and never shuffled. The items come in blocks of about ``BLOCK_BYTES``, a pass over the
texts for each, so that what a task holds of them is bounded however many there are.

Defined results: a null or empty text has no words and is not contaminated; an item without words has no
phrase; of items with equal ids each counts, the id once; an item without id marks words but is not listed; equal
documents get equal results; a column of ``docs`` named like a made one gives way, any other keeps its value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.llm import words as W
from trigrove.llm.batches import add_columns, named, others, packed, unpacked
from trigrove.llm.fmindex import FMIndex

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_SYMBOLS = 1 << 20

FOUND = "n_words long, hit_spans array<struct<start:int,end:int>>, hit_words array<struct<start:int,end:int>>, items array<string>"


class Phrases:
    """Windows of ``width`` words of the items (all words of shorter items), as symbols counted from 1."""

    def __init__(self, items: pd.DataFrame, width: int = WINDOW):
        data, offsets = W.utf8(pa.array(items["text"], pa.string()))
        cut = W.words(data, offsets, W.ALPHANUMERIC)
        hashes = cut.hashes()
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        found: dict[tuple[int, ...], set[str]] = {}
        for i, name in enumerate(items["item_id"]):
            own = symbols[cut.of[i] : cut.of[i + 1]].tolist()
            for k in range(max(1, len(own) - width + 1) if own else 0):
                holders = found.setdefault(tuple(own[k : k + width]), set())
                if name is not None and not pd.isna(name):
                    holders.add(str(name))
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for phrase in found:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.groups = [(np.array(p, np.int64), [found[x] for x in p]) for _, p in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


class Shard:
    """Sequences of phrase words of some texts, and where they stand."""

    def __init__(self):
        self.symbols: list[np.ndarray] = []
        self.text: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.size = 0

    def add(self, first_text: int, cut: W.Words, phrases: Phrases) -> None:
        hashes = cut.hashes()
        place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
        symbol = np.where(phrases.vocabulary[place] == hashes, place + 1, 0)
        text = cut.text_of()
        inside = symbol > 0
        new = np.ones(len(symbol), bool)
        new[1:] = ~inside[:-1] | (text[1:] != text[:-1])
        run = np.cumsum(new & inside)
        length = np.bincount(run[inside], minlength=run[-1] + 1 if len(run) else 1)
        kept = np.flatnonzero(inside & (length[run] >= phrases.shortest) if len(run) else inside)
        if not len(kept):
            return
        ends = np.flatnonzero(np.append(run[kept][1:] != run[kept][:-1], True)) + 1
        self.symbols.append(np.insert(symbol[kept], ends, 0))
        self.text.append(np.insert(text[kept] + first_text, ends, -1))
        self.word.append(np.insert(kept - cut.of[text[kept]], ends, -1))
        self.size += len(self.symbols[-1])

    def find(self, phrases: Phrases) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, set[str]]]]:
        """Word numbers that an occurrence covers, and items found, for each text that has any."""
        symbols, text, word = (np.concatenate(x) for x in (self.symbols, self.text, self.word))
        index = FMIndex(symbols, len(phrases.vocabulary))
        change = np.zeros(len(symbols) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for patterns, holders in phrases.groups:
            pattern, position = index.locate(*index.search(patterns))
            np.add.at(change, position, 1)
            np.add.at(change, position + patterns.shape[1], -1)
            pairs = np.unique(text[position] * len(holders) + pattern)
            for t, p in zip((pairs // len(holders)).tolist(), (pairs % len(holders)).tolist(), strict=True):
                items.setdefault(t, set()).update(holders[p])
        covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        at = text[covered]
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        places = [(int(text[c[0]]), word[c]) for c in np.split(covered, cuts) if len(c)]
        return places, list(items.items())


def _spans(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    gap = np.flatnonzero(np.diff(numbers) > 1)
    return numbers[np.concatenate([[0], gap + 1])], numbers[np.concatenate([gap, [len(numbers) - 1]])]


def _work(phrases: Phrases):
    def compute(texts: pa.Array) -> list[pa.Array]:
        data, offsets = W.utf8(texts)
        counts = np.zeros(len(texts), np.int64)
        places: list[tuple[int, np.ndarray]] = []
        items: dict[int, set[str]] = {}
        shard = Shard()

        def close() -> None:
            nonlocal shard
            if shard.size:
                where, which = shard.find(phrases)
                places.extend(where)
                items.update(which)
            shard = Shard()

        for a, b in W.slices(offsets):
            cut = W.words(data, offsets[a : b + 1], W.ALPHANUMERIC)
            counts[a:b] = cut.counts()
            if phrases.groups:
                shard.add(a, cut, phrases)
            if shard.size > SHARD_SYMBOLS:
                close()
        close()
        spans: list[list] = [[] for _ in counts]
        in_words: list[list] = [[] for _ in counts]
        for i, numbers in places:
            first, last = _spans(np.sort(numbers))
            in_words[i] = [{"start": s, "end": e + 1} for s, e in zip(first.tolist(), last.tolist(), strict=True)]
            cut = W.words(data, offsets[i : i + 2], W.ALPHANUMERIC)
            begins = np.cumsum((cut.data & 0xC0) != 0x80)  # code points up to each byte
            spans[i] = [
                {"start": int(begins[s] - 1), "end": int(begins[e - 1])} for s, e in zip(cut.start[first], cut.end[last], strict=True)
            ]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        names = [sorted(items.get(i, ())) for i in range(len(counts))]
        return [pa.array(counts), pa.array(spans, span), pa.array(in_words, span), pa.array(names, pa.list_(pa.string()))]

    return compute


def _merged(spans: Column) -> Column:
    """Union of spans, adjacent ones joined."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The kept columns of ``docs`` with ``n_words``, ``hit_spans`` (code points, merged), ``hit_words``
    (the same in word numbers) and ``items`` (ids of items with occurring windows, sorted as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    made = ["n_words", "hit_spans", "hit_words", "items"]
    kept = [c for c in others(docs, made) if keep is None or c in keep]
    found = docs.select(packed(kept), named(text).cast("string").alias("_text"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        phrases = Phrases(part.toPandas(), window)
        before = found.withColumnsRenamed({n: f"_{n}" for n in made[1:]})
        found = add_columns(before, [F.col("_text")], FOUND, lambda phrases=phrases: _work(phrases), None if k + 1 < blocks else [c for c in before.columns if c != "_text"])
        if k:
            found = found.withColumns(
                {
                    "hit_spans": _merged(F.concat("_hit_spans", "hit_spans")),
                    "hit_words": _merged(F.concat("_hit_words", "hit_words")),
                    "items": F.array_sort(F.array_union("_items", "items")),
                }
            ).drop("_hit_spans", "_hit_words", "_items")
    return found.select(*unpacked(kept), *made)


def digest(found: DataFrame) -> DataFrame:
    """Adds the counts, the hash of the item list and the verdict: 5 % of the words or more are hit."""
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text with its spans cut out."""
    kept = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("done"), s["end"].alias("at")
        ),
    )
    return F.concat(kept["done"], F.substring(text, kept["at"] + 1, F.length(text)))
