"""Words of many texts at once: the bytes of an Arrow column, cut and hashed by array operations.

A batch is passed over in slices of whole texts of about ``SLICE`` bytes, so that memory follows the
longest single text and not the batch. Null texts are empty texts here; callers that tell them apart
look at the column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``: a byte of a longer UTF-8 sequence is never one of these separators.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text with A-Z in lower case.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base or of its inverse, modulo 2^64."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, SLICE + 1), _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts. ``start`` and ``end`` are byte positions in ``data``; text ``i`` has the words ``of[i]`` to ``of[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal in every process."""
        values = self.data.astype(np.uint64)
        values += np.uint64(1)
        values *= _power("up", len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        found = (sums[self.end] - sums[self.start]) * _power("down", len(values) + 1)[self.start]
        return mix(found + (self.end - self.start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """Cuts the texts between ``offsets`` into words of the bytes marked in ``kind``."""
    begin = offsets[0]
    part = data[begin : offsets[-1]]
    if lower:
        part = LOWER[part]
    at = offsets - begin
    inside = np.zeros(len(part) + 2, np.int8)
    inside[1:-1] = kind[part]
    step = np.diff(inside)
    border = at[(at > 0) & (at < len(part))]
    joined = border[(inside[border] == 1) & (inside[border + 1] == 1)]  # a word on both sides of a text's end
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(joined):
        joined = np.unique(joined)
        start = np.sort(np.concatenate([start, joined]))
        end = np.sort(np.concatenate([end, joined]))
    return Words(part, at, start, end, np.searchsorted(start, at, side="left"))


def windows(values: np.ndarray, of: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive values within a text, and where each text's windows begin."""
    counts = np.maximum(np.diff(of) - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), starts
    total = np.full(n, np.uint64(mixed(seed)))
    for k in range(width):
        total += values[k : k + n] * np.uint64(mixed(seed + k + 1) | 1)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    same = text[:n] == text[width - 1 :]
    return mix(total[same]), starts


def mixed(x: int) -> int:
    return int(mix(np.array([x + 0x1234567], np.uint64))[0])
