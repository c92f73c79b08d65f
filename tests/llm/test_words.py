import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest

from trigrove.llm import fmindex
from trigrove.llm import words as W


@pytest.mark.parametrize("kind, pattern", [(W.SPACED, brute.SPACED), (W.ALPHANUMERIC, brute.ALPHANUMERIC)])
def test_words_of_a_column(kind, pattern):
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice(" \t\nab\x00Aé\x0b9-漢") for _ in range(rng.randrange(30))) for _ in range(300))]
    data, offsets = W.utf8(pa.array(texts)[1:])
    seen = {}
    for a, b in W.slices(offsets, 100):
        cut = W.words(data, offsets[a : b + 1], kind)
        hashes = cut.hashes()
        for i in range(b - a):
            found = [bytes(cut.data[cut.start[k] : cut.end[k]]).decode() for k in range(cut.of[i], cut.of[i + 1])]
            assert found == pattern.findall(brute.lower(texts[a + i + 1]))
            for word, h in zip(found, hashes[cut.of[i] : cut.of[i + 1]], strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_within_a_text():
    values = np.arange(7, dtype=np.uint64)
    hashes, starts = W.windows(values, np.array([0, 2, 2, 7]), 3, 1)
    assert starts.tolist() == [0, 0, 0, 3] and len(hashes) == 3
    assert (W.windows(values[2:], np.array([0, 5]), 3, 1)[0] == hashes).all()


def test_index_finds_and_locates_every_occurrence():
    rng = random.Random(2)
    for _ in range(40):
        runs = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 3)
        symbols = np.array([s for run in runs for s in (*run, 0)])
        index = fmindex.FMIndex(symbols, 5)
        text = "".join(map(str, symbols))
        for n in (1, 2, 4):
            patterns = np.array([[rng.randrange(1, 5) for _ in range(n)] for _ in range(20)])
            found = sorted(zip(*(x.tolist() for x in index.locate(*index.search(patterns))), strict=True))
            wanted = [(k, m.start()) for k, p in enumerate(patterns) for m in re.finditer(f"(?={''.join(map(str, p))})", text)]
            assert found == sorted(wanted)
