"""URL filters by a bit-parallel wildcard automaton.

A URL is canonical as its host, A-Z in lower case and with a dot before it, a separator that is no character,
and its path without query and fragment. All patterns are packed into the words of one Shift-And mask: a state
per letter, ``?`` as a letter that every symbol fits, ``*`` as a state that stays set. Every step moves the states
of all patterns for a whole group of URLs of a task at once; a URL is read once however many patterns there are.

Two kinds of patterns share the automaton. Rules (action, host, path) fit a host and all its subdomains, if the
path starts with the rule's; the longest that fits decides. Globs ``host/path`` decide where no rule does: a URL
that one fits is blocked, others are allowed.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule fits and no glob
but ``*`` does; equal URLs get equal verdicts; a very long URL costs a step per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.llm import words as W
from trigrove.llm.batches import add_columns, named

SEPARATOR = 256
GROUP_SYMBOLS = 1 << 20

RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Hosts of unwanted sites, programs and scripts.
BLOCKED = ("*spam-farm*/*", "*cheap-pills*/*", "*free-bets*/*", "*adult-x*/*", "*/*.exe", "*/cgi-bin/*")


@dataclass(frozen=True)
class Pattern:
    """Symbols to meet one after another (None: any), and before which of them, or after the last, any run may stand."""

    symbols: tuple[int | None, ...]
    gaps: frozenset[int]

    @staticmethod
    def glob(text: str) -> Pattern:
        """``host/path``: the first slash parts the two."""
        host, slash, path = text.partition("/")
        symbols: list[int | None] = []
        gaps: set[int] = set()
        for part, end in ((host, [SEPARATOR]), (slash + path, [])):
            for letter in part:
                if letter == "*":
                    gaps.add(len(symbols))
                else:
                    symbols.extend([None] if letter == "?" else letter.encode())
            symbols.extend(end)
        if not host.startswith("*"):
            symbols.insert(0, ord("."))
            gaps = {g + 1 for g in gaps}
        return Pattern(tuple(symbols), frozenset(gaps))

    @staticmethod
    def rule(host: str, path: str) -> Pattern:
        symbols = [*b".", *host.encode(), SEPARATOR, *path.encode()]
        return Pattern(tuple(symbols), frozenset({0, len(symbols)}))


class Automaton:
    """All patterns in words of 64 states; a state may not run over into the next pattern."""

    def __init__(self, patterns: list[Pattern]):
        self.sizes = [len(p.symbols) for p in patterns]
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        n_words = max(1, -(-int(self.begin[-1]) // 64))
        bits = lambda: np.zeros(n_words, np.uint64)
        self.fits, self.stays, self.first, self.anywhere = np.zeros((257, n_words), np.uint64), bits(), bits(), bits()
        for p, base in zip(patterns, self.begin.tolist(), strict=False):
            for i, symbol in enumerate(p.symbols):
                word, bit = divmod(base + i, 64)
                value = np.uint64(1) << np.uint64(bit)
                self.fits[slice(None) if symbol is None else symbol, word] |= value
                if i + 1 in p.gaps:
                    self.stays[word] |= value
                if i == 0:
                    self.first[word] |= value
                    if 0 in p.gaps:
                        self.anywhere[word] |= value

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which patterns fit each text whole. ``symbols`` has a row per step; texts are ordered by falling length."""
        states = np.zeros((len(lengths), len(self.first)), np.uint64)
        one, top, closed = np.uint64(1), np.uint64(63), ~self.first
        active = np.searchsorted(-lengths, -np.arange(1, len(symbols) + 1), side="right")
        for step, n in enumerate(active.tolist()):
            now = states[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= closed
            moved |= self.first if step == 0 else self.anywhere
            moved &= self.fits[symbols[step, :n]]
            states[:n] = moved | (now & self.stays)
        found = np.ones((len(lengths), len(self.sizes)), bool)
        for k, size in enumerate(self.sizes):
            if size:
                word, bit = divmod(int(self.begin[k]) + size - 1, 64)
                found[:, k] = (states[:, word] >> np.uint64(bit)) & one
        return found


def _groups(lengths: np.ndarray, order: np.ndarray):
    """Ranges of ``order`` of at most ``GROUP_SYMBOLS`` symbols when padded, or of one text."""
    first = 0
    while first < len(order):
        n = max(1, GROUP_SYMBOLS // max(1, int(lengths[order[first]])))
        yield order[first : first + n]
        first += n


def _matching(automaton: Automaton):
    def matches(hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        (host, host_at), (path, path_at) = W.utf8(hosts), W.utf8(paths)
        n_host, n_path = np.diff(host_at), np.diff(path_at)
        lengths = n_host + n_path + 2
        order = np.argsort(-lengths, kind="stable")
        found = np.zeros((len(lengths), len(automaton.sizes)), bool)
        for rows in _groups(lengths, order):
            symbols = np.zeros((int(lengths[rows[0]]), len(rows)), np.int16)
            symbols[0] = ord(".")
            for k, i in enumerate(rows.tolist()):
                symbols[1 : 1 + n_host[i], k] = host[host_at[i] : host_at[i + 1]]
                symbols[1 + n_host[i], k] = SEPARATOR
                symbols[2 + n_host[i] : lengths[i], k] = path[path_at[i] : path_at[i + 1]]
            found[rows] = automaton.run(symbols, lengths[rows])
        return found

    return matches


def _judging(rules, globs):
    names = [f"{host}{path}" for _, host, path in rules]
    by_length = sorted(range(len(rules)), key=lambda k: len(names[k]))
    automaton = Automaton([*(Pattern.rule(host, path) for _, host, path in rules), *map(Pattern.glob, globs)])

    def work():
        matches = _matching(automaton)

        def compute(hosts: pa.Array, paths: pa.Array) -> list[pa.Array]:
            found = matches(hosts, paths)
            rule = np.full(len(found), -1)
            for k in by_length:
                rule[found[:, k]] = k
            met = found[:, len(rules) :]
            blocked = met.any(axis=1)
            verdicts = np.where(rule < 0, np.where(blocked, "block", "allow"), np.array([*(a for a, _, _ in rules), ""], object)[rule])
            fitting = [[globs[j] for j in np.flatnonzero(row)] if any_ else [] for row, any_ in zip(met, blocked.tolist(), strict=True)]
            return [
                hosts, paths,
                pa.array([names[k] if k >= 0 else None for k in rule.tolist()], pa.string()), pa.array(verdicts.tolist(), pa.string()),
                pa.array(fitting, pa.list_(pa.string())),
            ]

        return compute

    return work


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), capitals, capitals.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, *, url: str = "url", rules=RULES, globs=BLOCKED, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``globs`` (those that fit)."""
    text = named(url).cast("string")
    schema = "host string, path string, rule string, verdict string, globs array<string>"
    return add_columns(pages, [host(text), path(text)], schema, _judging(rules, globs), keep)
