"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds more of the kind.

Tokens are runs of ``[A-Za-z0-9_+/-]`` and single other characters. A secret may begin (B) at any token; it goes on (I) without
a space. So the chain falls apart at spaces, and Viterbi runs over each stretch between two spaces: the decoding is exact and covers
every token of every text. Features are a token's shape (length, digits, case, entropy), the words beside it, and how a file looks
as a whole. What a token adds to the scores of its own place and of those beside it is worked out once per distinct token.

The field is fitted on at most ``SAMPLE`` texts with a pattern's match, as many others that have odd tokens (eight characters or more with
a digit, or twenty or more) and as many of the rest (the smallest by a hash); patterns give the tags, but are no features, so what resembles
their values in shape and company is found too. Of each text stretches with a match, those with an odd token or a sign nearby and plain ones
are drawn by a hash up to ``DRAWN`` tokens each (one at least), and weigh as much as all of their sort; long ones are cut to pieces of ``WINDOW`` tokens. An odd stretch without a match whose outline is that of
one with a match, and what follows a keyword without a match, may be secrets that the patterns miss: they are not learned from. Every text is scanned whole, in its own task, without shuffle.

Defined results: null and empty texts have no span; of a match and a span of the field that overlap the match stays;
without any match to learn from the field finds nothing.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.llm import words as W
from trigrove.llm.batches import add_columns, named

SAMPLE = 1000
DRAWN = 16
WINDOW = 64
LONG = 256
REMEMBERED = 200_000
BUCKETS = 1 << 12
O, B, I = range(3)  # noqa: E741
KINDS = ("assign", "access", "hex", "crf")

#: Fixed patterns; group 2 of the first and the whole of the others need a least length.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: What follows a keyword and a sign; without a match it may be a secret too short or too odd for the patterns.
_FOLLOWS = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*(\S+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+|[^\sA-Za-z0-9_+/-]")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_BESIDE = (-4, -3, -2, -1, 1, 2)
_SIGNS = frozenset("=:\"'`")
#: 0 for spaces, 1 for characters of runs, 2 for others; no space lies beyond the last place.
_KIND = np.array([0 if chr(c).isspace() else 1 if chr(c) in _RUN else 2 for c in range(0x3002)], np.int8)


def base_spans(text: str, longest: int) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns. ``longest``: letters of the longest token."""
    found = []
    if longest >= 1 and any(k in text.lower() for k in _KEYWORDS):
        found += [("assign", *m.span(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if longest >= LEAST_HEX:
        found += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def odd(token: str) -> bool:
    return len(token) >= 20 or (len(token) >= 8 and any(c.isdigit() for c in token))


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in map(token.count, set(token)))


def shape(token: str) -> list[str]:
    """What a token looks like."""
    if token[0] not in _RUN:
        return [f"plain:{'letters' if token.isalnum() else token}"]
    digits = sum(c.isdigit() for c in token)
    case = ("u" if any(c.isupper() for c in token) else "") + ("l" if any(c.islower() for c in token) else "")
    kind = "number" if digits == len(token) else "letters" if not digits else "hex" if re.fullmatch(r"[0-9a-fA-F]+", token) else "mixed"
    length = min(len(token) // 8, 6)
    return [
        f"kind:{kind}", f"length:{length}", f"kind-length:{kind}{length}", f"case:{case}{'d' if digits else ''}", f"entropy:{round(2 * _entropy(token))}",
        f"digits:{round(5 * digits / len(token))}", f"marks:{sum(c in '_+/-' for c in token) > 0}", f"size:{min(len(token), 20)}", f"odd:{odd(token)}",
    ]


def _file(text: str) -> list[str]:
    n = max(1, len(text))
    return [
        f"file-quotes:{min(3, round(200 * (text.count(chr(34)) + text.count(chr(39))) / n))}", f"file-signs:{min(3, round(200 * (text.count('=') + text.count(':')) / n))}",
        f"file-lines:{min(3, round(100 * text.count(chr(10)) / n))}",
    ]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@dataclass
class Tokens:
    """Tokens of some texts: code point positions in all of them joined by spaces. Text ``i`` begins at ``offsets[i]`` and has the tokens ``of[i]`` to ``of[i + 1]``."""

    joined: str
    points: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @staticmethod
    def cut(texts: list[str]) -> Tokens:
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.zeros(len(points) + 2, np.int8)
        kind[1:-1] = _KIND[np.minimum(points, len(_KIND) - 1)]
        own, single = kind[1:-1], kind[1:-1] == 2
        start = np.flatnonzero(single | ((own == 1) & (kind[:-2] != 1)))
        end = np.flatnonzero(single | ((own == 1) & (kind[2:] != 1))) + 1
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return Tokens(joined, points, offsets, start, end, np.searchsorted(start, offsets))

    def name(self, k: int) -> str:
        return self.joined[self.start[k] : self.end[k]]

    def heads(self) -> np.ndarray:
        """Tokens that begin a stretch without space."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.concatenate([[True], self.start[1:] != self.end[:-1]]))

    def longest(self) -> list[int]:
        """Letters of each text's longest token."""
        size = self.end - self.start
        return [int(size[a:b].max()) if a < b else 0 for a, b in itertools.pairwise(self.of.tolist())]

    def odd(self) -> np.ndarray:
        size = self.end - self.start
        digits = np.concatenate([[0], np.cumsum((self.points >= 48) & (self.points <= 57))])
        return (size >= 20) | ((size >= 8) & (digits[self.end] > digits[self.start]))


class Chunk:
    """The tokens ``first`` to ``last`` of a text, between two spaces, with the buckets of their features."""

    def __init__(self, cut: Tokens, first: int, last: int, file: list[int]):
        self.tokens = [(int(cut.start[k]), int(cut.end[k])) for k in range(first, last)]
        before, after = max(0, first - 4), min(len(cut.start), last + 2)
        self.names = [cut.name(k) for k in range(before, after)]
        self.own, self.file = slice(first - before, last - before), file
        self.starts = [True] * len(self.tokens)

    @cached_property
    def features(self) -> list[list[int]]:
        found = []
        for k in range(self.own.start, self.own.stop):
            beside = [beside_feature(d, self.names[k + d]) for d in _BESIDE if 0 <= k + d < len(self.names) and not odd(self.names[k + d])]
            found.append([*self.file, *(_bucket(f) for f in (*shape(self.names[k]), *beside, "any"))])
        return found

    def outline(self) -> str | None:
        """Kinds and lengths of the odd tokens and the signs around them; null without an odd token."""
        own = self.names[self.own]
        if not any(map(odd, own)):
            return None
        return " ".join(":".join(shape(t)[:2]) if odd(t) else "w" if t[0].isalnum() else t for t in own)

    def sort(self, tags: list[int]) -> int:
        """0 with a match, 1 with an odd token or a sign in it or up to four tokens before, else 2."""
        own = self.names[self.own]
        return 0 if B in tags else 1 if any(map(odd, own)) or not _SIGNS.isdisjoint(self.names[: self.own.stop]) else 2


def beside_feature(distance: int, name: str) -> str:
    return f"{distance}:{name.lower()}"


def stretches(cut: Tokens) -> list[tuple[int, int]]:
    """First token and end of each stretch without space."""
    return list(itertools.pairwise([*cut.heads().tolist(), len(cut.start)]))


def chunks(text: str, at: list[int]) -> list[Chunk]:
    """The stretches without space around the positions ``at`` (rising)."""
    cut = Tokens.cut([text])
    file = [_bucket(f) for f in _file(text)]
    return [Chunk(cut, a, b, file) for a, b in stretches(cut) if any(cut.start[a] <= p < cut.end[b - 1] for p in at)]


def _tags(tokens: list[tuple[int, int]], spans: list[tuple[str, int, int, int]]) -> list[int]:
    """Tags that the fixed patterns give: a value begins at the first token that holds any of it."""
    tags, open_, ended = [], None, 0
    for start, end in tokens:
        while ended < len(spans) and spans[ended][2] <= start:
            ended += 1
        span = next((s for s in itertools.takewhile(lambda s: s[1] < end, itertools.islice(spans, ended, None)) if s[3] < end and start < s[2]), None)
        tags.append(O if span is None else I if open_ == span[3] else B)
        open_ = None if span is None else span[3]
    return tags


def pieces(tags: list[int], most: int = WINDOW) -> list[tuple[int, int]]:
    """A stretch cut into pieces of at most ``most`` tokens to learn from; none begins inside a value, so what a value has beyond a piece is left out."""
    found, first = [], 0
    while first < len(tags):
        found.append((first, min(first + most, len(tags))))
        first = next((k for k in range(found[-1][1], len(tags)) if tags[k] != I), len(tags))
    return found


class Field:
    """Weights of the conditional random field: features by tag, and steps from tag to tag within a chunk."""

    def __init__(self, features: np.ndarray, steps: np.ndarray):
        self.features, self.steps = features, steps

    def decode(self, chunk: Chunk) -> list[int]:
        """The likeliest tags (Viterbi)."""
        return self.best([self.features[own].sum(axis=0).tolist() for own in chunk.features])

    def best(self, emits: list[list[float]]) -> list[int]:
        """The likeliest tags of one stretch by the scores of its tokens."""
        never = -1e9
        steps = self.steps.tolist()
        scores, back = None, []
        for emit in emits:
            if scores is None:
                scores = [emit[O], emit[B], never]
                continue
            choices = [[scores[p] + steps[p][t] for p in range(3)] for t in range(3)]
            choices[I][O] = never
            best = [max(range(3), key=c.__getitem__) for c in choices]
            back.append(best)
            scores = [choices[t][best[t]] + emit[t] for t in range(3)]
        tag = max(range(3), key=lambda t: scores[t])
        tags = [tag]
        for best in reversed(back):
            tag = best[tag]
            tags.append(tag)
        return tags[::-1]

    def best_of_all(self, emits: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The likeliest tags of all stretches, which begin at ``heads``: those of up to ``LONG`` tokens step by step together."""
        tags = np.zeros(len(emits), np.int8)
        sizes = np.diff(heads, append=len(emits))
        for k in np.flatnonzero(sizes > LONG).tolist():
            tags[heads[k] : heads[k] + sizes[k]] = self.best(emits[heads[k] : heads[k] + sizes[k]].tolist())
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(-sizes[short], kind="stable")]
        first, size = heads[short], sizes[short]
        if not len(short):
            return tags
        scores = emits[first]
        scores[:, I] = -1e9
        step = self.steps.copy()
        step[O, I] = -1e9
        back, counts = [], [int(np.searchsorted(-size, -k, side="left")) for k in range(1, int(size[0]))]
        for k, n in enumerate(counts, 1):
            choices = scores[:n, :, None] + step
            best = choices.argmax(axis=1)
            scores[:n] = np.take_along_axis(choices, best[:, None, :], axis=1)[:, 0] + emits[first[:n] + k]
            back.append(best)
        tag = scores.argmax(axis=1)
        tags[first + size - 1] = tag
        for k in range(int(size[0]) - 1, 0, -1):
            n = counts[k - 1]
            tag[:n] = back[k - 1][np.arange(n), tag[:n]]
            tags[first[:n] + k - 1] = tag[:n]
        return tags


class Scores:
    """Scores of the tags of every token; what a distinct token adds at its place and beside it is remembered, for ``REMEMBERED`` tokens."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.own, self.side = np.zeros((1, 3)), np.zeros((1, len(_BESIDE), 3))  # row 0: no token

    def learn(self, hashes: list[int], names: list[str]) -> None:
        w = self.field.features
        shapes = [[_bucket(f) for f in (*shape(t), "any")] for t in names]
        at = np.cumsum([0, *(len(s) for s in shapes[:-1])])
        own = np.add.reduceat(w[np.fromiter(itertools.chain.from_iterable(shapes), np.int64)], at, axis=0)
        side = w[np.array([[_bucket(beside_feature(d, t)) for d in _BESIDE] for t in names])]
        side[[odd(t) for t in names]] = 0
        self.rows.update(zip(hashes, range(len(self.own), len(self.own) + len(names)), strict=True))
        self.own, self.side = np.concatenate([self.own, own]), np.concatenate([self.side, side])

    def emits(self, cut: Tokens, texts: list[str]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.clear()
        hashes = W.Words(cut.points, cut.offsets, cut.start, cut.end, cut.of).hashes()
        values, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = values.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.rows]
        if new:
            self.learn([keys[k] for k in new], [cut.name(first[k]) for k in new])
        row = np.array([self.rows[h] for h in keys], np.int64)[which]
        text = np.repeat(np.arange(len(texts)), np.diff(cut.of))
        place = np.arange(len(row)) + 4 * (text + 1)
        padded = np.zeros(len(row) + 4 * (len(texts) + 1), np.int64)
        padded[place] = row
        emits = self.own[row] + np.array([self.field.features[[_bucket(f) for f in _file(t)]].sum(axis=0) for t in texts])[text]
        for k, d in enumerate(_BESIDE):
            emits += self.side[padded[place + d], k]
        return emits


def fit(examples: list[tuple[list[list[int]], list[int], float]], rounds: int = 150, penalty: float = 0.02, rate: float = 0.1) -> Field:
    """Maximum likelihood of weighted chunks (features, tags, weight) by forward-backward sums over all of about one length at once (Adam steps)."""
    groups: dict[int, list] = {}
    for example in examples:
        groups.setdefault(1 << (len(example[1]) - 1).bit_length(), []).append(example)
    packed = []
    for length, group in groups.items():
        n = len(group)
        real = np.zeros((n, length), bool)
        allowed = np.zeros((n, length, 3))
        gold = np.full((n, length), O)
        where, which = [], []
        weights = np.array([weight for _, _, weight in group])
        for k, (features, tags, _) in enumerate(group):
            real[k, : len(tags)] = True
            gold[k, : len(tags)] = tags
            for t, own in enumerate(features):
                where += [k * length + t] * len(own)
                which += own
        allowed[:, 0, I] = -1e9
        packed.append((real, allowed, gold, weights, np.array(where), np.array(which)))
    w, s = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    closed = np.zeros((3, 3))
    closed[O, I] = -1e9
    moments = [np.zeros_like(x) for x in (w, w, s, s)]
    total = len(examples)
    for round_ in range(1, rounds + 1):
        dw, ds = penalty * w / 100, penalty * s / 100
        for real, allowed, gold, weights, where, which in packed:
            n, length = real.shape
            emit = np.stack([np.bincount(where, w[which, t], n * length) for t in range(3)], axis=1).reshape(n, length, 3) + allowed
            step = s + closed
            alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            alpha[:, 0] = emit[:, 0]
            for t in range(1, length):
                ahead = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + emit[:, t]
                alpha[:, t] = np.where(real[:, t, None], ahead, alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                ahead = np.logaddexp.reduce(step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(real[:, t + 1, None], ahead, beta[:, t + 1])
            norm = np.logaddexp.reduce(alpha[:, -1], axis=1)
            node = np.exp(np.minimum(0, alpha + beta - norm[:, None, None])) * real[:, :, None]
            node -= np.eye(3)[gold] * real[:, :, None]
            node *= weights[:, None, None]
            flat = node.reshape(-1, 3)
            for t in range(3):
                dw[:, t] += np.bincount(which, flat[where, t], BUCKETS) / total
            for t in range(1, length):
                both = np.exp(np.minimum(0, alpha[:, t - 1, :, None] + step + (emit[:, t] + beta[:, t])[:, None, :] - norm[:, None, None]))
                both *= (real[:, t] * weights)[:, None, None]
                ds += both.sum(axis=0) / total
                np.subtract.at(ds, (gold[real[:, t], t - 1], gold[real[:, t], t]), weights[real[:, t]] / total)
        for x, d, m, v in ((w, dw, moments[0], moments[1]), (s, ds, moments[2], moments[3])):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-8)
    return Field(w, s)


def _cuts(column: pa.Array):
    """Tokens of the texts of a column, in slices of about a megabyte of whole texts; null texts are empty."""
    texts = [t or "" for t in column.to_pylist()]
    for a, b in W.slices(W.utf8(column)[1]):
        yield texts[a:b], Tokens.cut(texts[a:b])


def drawn(text: str) -> list[tuple[Chunk, list[int], float]]:
    """Stretches of a text to learn from, with tags and weights: of each sort the smallest by a hash, up to ``DRAWN`` tokens."""
    cut = Tokens.cut([text])
    spans = base_spans(text, max(cut.longest()))
    unsure = [m.start(1) for m in _FOLLOWS.finditer(text)]
    file = [_bucket(f) for f in _file(text)]
    sorts: dict[int, list] = {}
    every = _tags(list(zip(cut.start.tolist(), cut.end.tolist(), strict=True)), spans)
    for a, b in stretches(cut):
        if B not in every[a:b] and bisect.bisect_left(unsure, cut.end[b - 1]) > bisect.bisect_left(unsure, cut.start[a]):
            continue
        for first, last in pieces(every[a:b]):
            chunk, tags = Chunk(cut, a + first, a + last, file), every[a + first : a + last]
            sorts.setdefault(chunk.sort(tags), []).append((zlib.crc32("\0".join(chunk.names).encode("utf-8", "surrogatepass")), chunk.tokens[0], chunk, tags))
    found = []
    for _, members in sorted(sorts.items()):
        members.sort(key=lambda m: m[:2])
        taken = []
        for member in members:
            if taken and sum(len(m[3]) for m in taken) + len(member[3]) > DRAWN:
                break
            taken.append(member)
        found += [(chunk, tags, len(members) / len(taken)) for _, _, chunk, tags in taken]
    return found


def _example_rows(batches):
    """Chunks of the texts with the tags that the fixed patterns give."""
    for batch in batches:
        found = [x for text in batch.column(0).to_pylist() for x in drawn(text or "")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c.features for c, _, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([t for _, t, _ in found], pa.list_(pa.int32())),
                pa.array([w for _, _, w in found], pa.float64()), pa.array([c.outline() for c, _, _ in found], pa.string()),
            ],
            names=["features", "tags", "weight", "outline"],
        )


def _kinds():
    """2 for texts with a match of the fixed patterns, 1 for others with odd tokens, 0 for others with tokens, else null."""

    def compute(column: pa.Array) -> list[pa.Array]:
        kinds = []
        for texts, cut in _cuts(column):
            strange = np.concatenate([[0], np.cumsum(cut.odd())])[cut.of]
            for text, longest, n in zip(texts, cut.longest(), np.diff(strange).tolist(), strict=True):
                kinds.append(None if not longest else 2 if base_spans(text, longest) else int(n > 0))
        return [pa.array(kinds, pa.int32())]

    return compute


def learned(docs: DataFrame, *, text: str = "text", most: int = SAMPLE) -> Field | None:
    """A field from at most ``most`` texts with a match, as many others with odd tokens and as many of the rest."""
    rows = docs.select(named(text).cast("string").alias("text")).where("text is not null")
    marked = add_columns(rows.withColumn("mark", F.xxhash64("text")), [F.col("text")], "kind int", _kinds, ["mark"]).where("kind is not null").distinct()
    picked = marked.where("kind = 2").orderBy("mark").limit(most)
    for kind in (1, 0):
        picked = picked.union(marked.where(f"kind = {kind}").orderBy("mark").limit(most))
    sample = rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(picked.select("mark")), "mark").dropDuplicates(["mark"]).select("text")
    made = sample.mapInArrow(_example_rows, "features array<array<int>>, tags array<int>, weight double, outline string")
    found = made.groupBy("features", "tags", "outline").agg(F.max("weight").alias("weight")).collect()
    secret = {r["outline"] for r in found if B in r["tags"]} - {None}
    examples = sorted((r["features"], r["tags"], r["weight"]) for r in found if B in r["tags"] or r["outline"] not in secret)
    return fit(examples) if any(B in tags for _, tags, _ in examples) else None


def _scanning(field: Field | None):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    scores = Scores(field) if field is not None else None

    def compute(column: pa.Array) -> list[pa.Array]:
        out = []
        for texts, cut in _cuts(column):
            added = [[] for _ in texts]
            if scores is not None and len(cut.start):
                tags = field.best_of_all(scores.emits(cut, texts), cut.heads())
                inside = np.flatnonzero(np.concatenate([tags, [O]]) != I)
                for k in np.flatnonzero(tags == B).tolist():
                    last = int(inside[np.searchsorted(inside, k, side="right")]) - 1
                    i = int(np.searchsorted(cut.of, k, side="right")) - 1
                    added[i].append((int(cut.start[k] - cut.offsets[i]), int(cut.end[last] - cut.offsets[i])))
            for text, longest, more in zip(texts, cut.longest(), added, strict=True):
                spans = base_spans(text, longest)
                found = [s[:3] for s in spans] + [("crf", a, b) for a, b in more if not any(s[1] < b and a < s[2] for s in spans)]
                found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
        return [pa.array(out, pa.list_(span))]

    return compute


def scanned(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` with ``spans`` (kind, start, end in code points), by start, then kind."""
    field = learned(docs, text=text)
    return add_columns(docs, [named(text).cast("string")], "spans array<struct<kind:string,start:int,end:int>>", lambda: _scanning(field), keep)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; of overlapping spans the first begins the cut and the last ends it."""
    cut = F.aggregate(
        spans, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["done"]).alias("done"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    return F.concat(cut["done"], F.substring(text, cut["at"] + 1, F.length(text)))
