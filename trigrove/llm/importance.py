"""Target-distribution importance resampling over hashed n-grams.

A text becomes its words with single spaces between them. A regular expression goes over the lines of a slice of texts with overlapped
matches: at every space a lookahead takes the next word and the two after it, so that the spans of the n-grams
that begin there come out of one match. Their bytes are counted by CRC-32. A bucket's gain is the logarithm of how
much likelier it is in the target than in the raw texts; a document's weight is the sum over its n-grams, its score adds
Gumbel noise drawn from its id, and the highest scores are the draw.

CRCs of words are computed by columns of bytes; those of longer n-grams follow from them, since appending n bytes to
something multiplies its CRC by a power of the polynomial, a table look-up for each n. Words beyond ``LONG`` bytes are
left to the library.

Every text is scanned once, where it lies; what remains is its sorted bucket numbers, delta-coded, in a written table,
which is counted and then weighed. Counts cover every document. Only the counts of ``BUCKETS`` buckets reach the driver. The
order of the draw is made by range partitions.

Defined results: a null text has no words; texts without n-grams weigh 0. A null id counts as an empty one and comes last
among ties. Repeated rows are documents of their own. Extra columns follow, but for those named like new ones. Empty tables
give an empty result; without a target the gains are those of an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.llm.batches import add_columns, named, others
from trigrove.llm.ordering import numbered
from trigrove.llm.words import slices
from trigrove.plans.shared import new_folder

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
AT_ONCE = 1 << 15
SLICE = 1 << 19
LONG = 64

_WORD = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes of words, A-Z in lower case; all others are a space.
_PLAIN = bytes(c + 32 * (0x41 <= c <= 0x5A) if c in _WORD else 0x20 for c in range(256))
_GRAMS = regex.compile(rb" (?=([^ \n]+)(?: ([^ \n]+)(?: ([^ \n]+))?)?)")
_ENDS = methodcaller("end", 0, 1, 2, 3)  # of the space, which is where the grams begin, and of each gram


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each byte, and what ``n`` more bytes make of each byte of a CRC: (n, which byte, its value)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    more = np.zeros((LONG + 2, 4, 256), np.uint32)
    more[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, LONG + 2):
        more[n] = step[more[n - 1] & 255] ^ (more[n - 1] >> 8)
    return step, more


_STEP, _MORE = _tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def _longer(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What CRCs become before the CRC of ``n`` further bytes is added."""
    return _MORE[n, 0, crc & 255] ^ _MORE[n, 1, crc >> 8 & 255] ^ _MORE[n, 2, crc >> 16 & 255] ^ _MORE[n, 3, crc >> 24]


def _word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    begin, left = start[order], size[order]
    crc = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    n = len(begin)
    for k in range(int(left[0]) if n else 0):
        n = int(np.searchsorted(-left[:n], -k, side="left"))  # those with a byte number k
        crc[:n] = _STEP[(crc[:n] ^ data[begin[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def spans(lines: bytes) -> Iterator[np.ndarray]:
    """(start, end of a word, end with the next word, end with the next two), -1 where there is none, for every word of lines that begin with a space."""
    found = map(_ENDS, _GRAMS.finditer(lines, overlapped=True))
    while len(part := np.fromiter(chain.from_iterable(islice(found, AT_ONCE)), np.int64)):
        yield part.reshape(-1, 4)


def gram_crcs(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, CRC-32 of every run of one to three words, and which text each is of."""
    lines = [b" " + b" ".join(t.translate(_PLAIN).split()) for t in texts]
    line = b"\n".join(lines)
    begins = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    data = np.frombuffer(line, np.uint8)
    n_words, crcs, owners = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for at in spans(line):
        owner = np.searchsorted(begins, at[:, 0], side="right") - 1
        n_words += np.bincount(owner, minlength=len(texts))
        start = at[:, :1] + np.where(np.arange(3) > 0, at[:, :3] - at[:, :1] + 1, 0)  # of the last word of each run
        there = at[:, 1:] >= 0
        size = np.where(there, at[:, 1:] - start, 0)
        usual = there & (size <= LONG)
        whole = np.zeros(size.shape, np.uint32)
        whole[:, 0] = _word_crcs(data, start[:, 0], np.where(usual[:, 0], size[:, 0], 0))
        # The other words of a run are the first words of the next runs, but for those that the following part begins with.
        for k in (1, 2):
            whole[:-k, k] = whole[k:, 0]
            whole[-k:, k] = _word_crcs(data, start[-k:, k], np.where(usual[-k:, k], size[-k:, k], 0))
        grams = [whole[:, 0]]
        for k in (1, 2):
            n = np.where(usual[:, k], size[:, k], 0)
            grams.append(_longer(_longer(grams[-1], np.ones_like(n)) ^ _SPACE, n) ^ whole[:, k])
        found = np.stack(grams, 1)
        odd = there & np.logical_or.accumulate(size > LONG, axis=1)
        for i, k in zip(*np.nonzero(odd), strict=True):
            found[i, k] = zlib.crc32(line[at[i, 0] : at[i, k + 1]])
        crcs.append(found[there])
        owners.append(np.repeat(owner, there.sum(1)))
    return n_words, np.concatenate(crcs), np.concatenate(owners)


def packed(buckets: np.ndarray) -> bytes:
    """Bucket numbers in order, as differences: all low bytes, then all high ones, which hardly take room when compressed."""
    return np.diff(buckets, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel(), dtype=np.int64)


def _scanning(texts: pa.Array) -> list[pa.Array]:
    words, sizes, blobs = [], [], []
    sums = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    for a, b in slices(sums, SLICE):
        n, crcs, owner = gram_crcs([t or b"" for t in texts.slice(a, b - a).to_pylist()])
        held = np.sort(owner << 14 | crcs % BUCKETS)  # a bucket takes 14 bits
        ends = np.searchsorted(held >> 14, np.arange(b - a), side="right")
        buckets = held & (1 << 14) - 1
        blobs += [packed(buckets[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        words.append(n)
        sizes.append(np.diff(ends, prepend=0))
    return [pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(blobs, pa.binary())]


def scanned(df: DataFrame, text: Column, keep: Sequence[str]) -> DataFrame:
    """``n_words``, ``n_features`` and the packed buckets of each row, beside the columns ``keep``."""
    return add_columns(df, [text.cast("string").cast("binary")], "n_words long, n_features long, _buckets binary", lambda: _scanning, keep)


def _counting(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for blob in batch.column(0):
            counts += np.bincount(unpacked(blob.as_py()), minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for row in rows.select("_buckets").mapInArrow(_counting, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]  # BUCKETS rows at most
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of each bucket, one added to every count."""
    r, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (r.sum() + BUCKETS) / ((r + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for an id at every run."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    part = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(part))).cast("long")


MADE = ("n_words", "n_features", "weight", "score", "rank")


def resampled(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """The kept columns of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null unless drawn)."""
    kept = [c for c in others(docs, MADE) if keep is None or c in keep]
    rows = docs.select(named(doc_id).alias("_id"), named(text).alias("_text"), *[named(c).alias(f"_own{i}") for i, c in enumerate(kept)])
    names = ["_id", *[f"_own{i}" for i in range(len(kept))]]
    folder = new_folder(docs.sparkSession, "buckets")
    scanned(rows, F.col("_text"), names).write.option("compression", "zstd").parquet(folder)
    scan = docs.sparkSession.read.parquet(folder)
    aimed = target.select(named(target_text).alias("_text"))
    gain = gains(bucket_counts(scan), bucket_counts(scanned(aimed, F.col("_text"), [])))

    def weighing(blobs: pa.Array) -> list[pa.Array]:
        return [pa.array([int(gain[unpacked(b.as_py())].sum()) for b in blobs], pa.int64())]

    weighed = add_columns(scan, [F.col("_buckets")], "weight long", lambda: weighing, [*names, "n_words", "n_features"])
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    able = F.col("n_words") >= least_words
    n_drawn = scan.where(able).count() * percent // 100
    order = [able.desc(), F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_row")]
    placed = numbered(scored.withColumn("_row", F.monotonically_increasing_id()), order, "_place")
    rank = F.when(able & (F.col("_place") < n_drawn), F.col("_place") + 1)
    return placed.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(kept)], "n_words", "n_features", "weight", "score", rank.alias("rank"))
