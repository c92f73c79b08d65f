"""Quality rules: counts that describe a text, and how much likelier its n-grams are in trusted text.

Single tokens and pairs are hashed to ``BUCKETS`` counters. Two multinomials are estimated, one over all
documents and one over every document that the labels call good; a text's score is the mean log-likelihood
ratio of its n-grams. Texts whose score is below ``THRESHOLD`` are rejected, each by its own score alone.

Both are counted in one pass over all texts. Ids of good documents of at most ``MOST_BROADCAST`` bytes go to the
tasks; more are joined to the documents in a shuffle, with the same counts. Counting adds up arrays within a task
and shuffles one row per bucket and task, so a common word or a hot source makes no large group.

Defined results: a null text is an empty one and has no n-grams, its score is 0; without trusted
documents every score is 0 and only the rules reject. Repeated rows count as often as they stand there and get one
verdict; a score equal to the threshold is kept; columns of ``docs`` named like one that is made give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm import words as W
from trigrove.llm.batches import add_columns, named

BUCKETS = 1 << 14
MOST_BROADCAST = 32 << 20
THRESHOLD = -0.4
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: 0: between tokens, 1: letters and digits, 2: other characters.
_TOKEN_KIND = np.where(W.SPACED & (np.arange(256) > 32), np.where(W.ALPHANUMERIC[W.LOWER], 1, 2), 0).astype(np.int8)


def _runs(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """Tokens: runs of letters and digits, and runs of other characters, in lower case."""
    begin = offsets[0]
    part = W.LOWER[data[begin : offsets[-1]]]
    at = offsets - begin
    kind = _TOKEN_KIND[part]
    new = np.ones(len(part), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[at < len(part)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(part)) if len(start) else start
    token = kind[start] > 0
    start, end = start[token], end[token]
    return W.Words(part, at, start, end, np.searchsorted(start, at, side="left"))


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of single tokens and of pairs, each with where a text's begin."""
    cut = _runs(data, offsets)
    hashes = cut.hashes()
    pairs, starts = W.windows(hashes, cut.of, 2, 7)
    return hashes % np.uint64(buckets), cut.of, pairs % np.uint64(buckets), starts


def _counting(buckets: int):
    """Counts of a task: raw over all rows, trusted over marked ones; a row for each bucket met."""

    def run(batches):
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            data, offsets = W.utf8(batch.column(0))
            trusted = np.array(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for a, b in W.slices(offsets):
                ones, of_ones, pairs, of_pairs = _grams(data, offsets[a : b + 1], buckets)
                for grams, of in ((ones, of_ones), (pairs, of_pairs)):
                    grams = grams.astype(np.int64)
                    counts[0] += np.bincount(grams, minlength=buckets)
                    if trusted[a:b].any():
                        counts[1] += np.bincount(grams[np.repeat(trusted[a:b], np.diff(of))], minlength=buckets)
        bucket = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(counts[0][bucket]), pa.array(counts[1][bucket])], names=["bucket", "raw", "trusted"])

    return run


def _marked(docs: DataFrame, trusted_ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text, whether it is trusted) of every document."""
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_id")).where("_id is not null").distinct()
    size = ids.agg(F.sum(F.octet_length(F.col("_id").cast("string")) + 16)).first()[0] or 0
    rows = docs.select(named(doc_id).alias("_doc"), named(text).cast("string").alias("_text"))
    side = F.broadcast(ids) if size <= MOST_BROADCAST else ids.hint("merge")
    return rows.join(side, rows["_doc"] == ids["_id"], "left").select("_text", F.col("_id").isNotNull().alias("_trusted"))


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log(trusted / raw) of every bucket, with one added to each counter."""
    found = _marked(docs, trusted_ids, doc_id, text).mapInArrow(_counting(buckets), "bucket long, raw long, trusted long")
    counted = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, trusted = np.ones(buckets), np.ones(buckets)
    for row in counted.collect():  # ``buckets`` rows at most
        raw[row["bucket"]] += row["raw"]
        trusted[row["bucket"]] += row["trusted"]
    if trusted.sum() == buckets:
        return np.zeros(buckets)
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of all documents that the labels call good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def _per_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums over the values of each text."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return sums[of[1:]] - sums[of[:-1]]


def _own_sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums over the values of each text, each from its own values alone: the same beside any other texts."""
    sums, some = np.zeros(len(of) - 1), of[1:] > of[:-1]
    if some.any():
        sums[some] = np.add.reduceat(values, of[:-1][some])
    return sums


def _again(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its text holds it twice or more, and whether it stands there earlier."""
    key = W.mix(values + W.mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return twice, earlier


def _measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    cut = W.words(data, offsets, W.SPACED, lower=False)
    part, at = cut.data, cut.offsets
    chars = _per_text(W.SPACED[part] & ((part & 0xC0) != 0x80), at)
    symbols = _per_text(_SYMBOLS[part], at)
    not_break = np.ones(256, bool)
    not_break[0x0A] = False
    lines = W.words(data, offsets, not_break, lower=False)
    has_word = np.concatenate([[0], np.cumsum(W.SPACED[part])])
    worded = has_word[lines.end] > has_word[lines.start]
    earlier = _again(lines.hashes()[worded], lines.text_of()[worded])[1]
    dup_lines = np.bincount(lines.text_of()[worded][earlier], minlength=len(at) - 1)
    grams, starts = W.windows(cut.hashes(), cut.of, REPEAT_WINDOW, 11)
    n_windows = np.diff(starts)
    text = np.repeat(np.arange(len(n_windows)), n_windows)
    place = np.arange(len(grams)) - starts[:-1][text] + cut.of[:-1][text]
    found = place[_again(grams, text)[0]]
    change = np.zeros(len(cut.start) + 1, np.int64)
    change[found] += 1
    change[found + REPEAT_WINDOW] -= 1
    repeated = _per_text(np.cumsum(change[:-1]) > 0, cut.of)
    return [cut.counts(), chars, symbols, dup_lines, repeated]


def _scoring(ratios: np.ndarray):
    def compute(texts: pa.Array) -> list[pa.Array]:
        data, offsets = W.utf8(texts)
        out: list[list[np.ndarray]] = []
        for a, b in W.slices(offsets):
            ones, of_ones, pairs, of_pairs = _grams(data, offsets[a : b + 1], len(ratios))
            n = np.diff(of_ones) + np.diff(of_pairs)
            total = _own_sums(ratios[ones.astype(np.int64)], of_ones) + _own_sums(ratios[pairs.astype(np.int64)], of_pairs)
            out.append([*_measures(data, offsets[a : b + 1]), total / np.maximum(n, 1)])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return [*(pa.array(c.astype(np.int64)) for c in columns[:-1]), pa.array(columns[-1])]

    return compute


def judged(
    docs: DataFrame, trusted_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    threshold: float = THRESHOLD, buckets: int = BUCKETS,
) -> DataFrame:
    """The kept columns of ``docs`` with the counts, ``score``, ``base_failed`` and ``kept``. Two passes; texts are shuffled only if there are too
    many trusted ids to send to the tasks."""
    ratios = log_ratios(docs, trusted_ids, doc_id=doc_id, text=text, buckets=buckets)
    scored = add_columns(
        docs, [named(text).cast("string")],
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean",
        lambda: _with_verdict(_scoring(ratios), threshold), keep,
    )
    return scored


def _with_verdict(scoring, threshold: float):
    def compute(texts: pa.Array) -> list[pa.Array]:
        columns = scoring(texts)
        n_words, repeated, score = (columns[i].to_numpy() for i in (0, 4, 5))
        failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
        return [*columns, pa.array(failed), pa.array(~failed & (score >= threshold))]

    return compute
