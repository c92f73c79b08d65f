"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer, a trie over letters, turns words into classes with weights: insults, threats, targets,
negations and reported speech. Words of the fixed lists keep their class; of other words the longest learned stem that they begin
with counts. Four small transducers over
classes follow, composed to one automaton: targets near an insult raise its weight, a negation before it
or a verb of saying in the clause lowers it, and a threat counts only with a target after it. A clause's score
is the sum over its matches; a document's score is a logistic function of its best clause, the sum and the mean
over its clauses, and how many different stems were met.

Insults and their weights are learned: log-odds of their document frequencies in toxic and other
documents, lowered by ``CAUTION`` standard errors; first those of whole words, then those of beginnings of at least ``LEAST_STEM`` letters, counted
over the words that are not learned themselves, so that no beginning inherits the weight of a word ("path" of "pathetic"). At most ``SAMPLE`` labelled documents are learned from (the
smallest by a hash of the id), equal texts once; every document is scored, each in its own task, without shuffle.

Defined results: null and empty texts have no clause and get the score of a text without match; without
labelled documents of both kinds nothing is learned and all scores are below a half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.batches import add_columns, named, remainder
from trigrove.plans.shared import written

SAMPLE = 20_000
STEMS = 20_000
LEAST_STEM, LONGEST_STEM = 5, 16
LONGEST_WORD = 40
LEAST_TOXIC = 5
LEAST_WEIGHT = 1.0
CAUTION = 2.0
REACH = 3
MEMO = 1 << 20

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
MET = 6  # written by the grammar where a threat has found its target

#: Fixed word lists.
WORDS = {
    THREAT: "kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beating shoot shoots shooting stab stabs stabbed stabbing "
            "murder murders murdered murdering töten töte tötet getötet umbringen umbringe umbringt ermorden ermorde ermordet schlagen schlage schlägt verprügeln verprügele "
            "tuer tue tuerai tuera tuerons frapper frappe frapperai frappera détruire détruirai détruira assassiner assassine "
            "matar mato mata mataré matará matamos golpear golpeo golpearé golpeará destruir destruyo destruiré destruirá asesinar asesinaré",
    TARGET: "you your yours he him his she her they them their du dich dir dein ihr euch tu te toi vous ton votre tú ti usted ustedes vosotros",
    NEGATION: "not no never nobody nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says say told quoted called claimed wrote sagte sagt nannte schrieb dit disait écrit dijo dice escribió",
}
THREAT_WEIGHT = 2.0
_CLAUSES = re.compile(r"[.!?;:,()\n|]+")
_WORDS = re.compile(r"[^\W\d_]+")


class Transducer:
    """Reads a class, writes a class and a factor: ``arcs[state][class] = (state, class, factor)``. State 0 is the first; all are final."""

    def __init__(self, arcs: list[dict[int, tuple[int, int, float]]]):
        self.arcs = arcs

    def compose(self, after: Transducer) -> Transducer:
        """What ``after`` makes of what this one writes, as one transducer over the pairs of states that are reached."""
        number, arcs = {(0, 0): 0}, []
        for first, second in (todo := [(0, 0)]):
            arcs.append({})
            for symbol, (to, out, factor) in self.arcs[first].items():
                to2, out2, factor2 = after.arcs[second][out]
                if (to, to2) not in number:
                    number[to, to2] = len(number)
                    todo.append((to, to2))
                arcs[-1][symbol] = (number[to, to2], out2, factor * factor2)
        return Transducer(arcs)


def _near(trigger: int, about: Iterable[int], factor: float, reach: int = REACH) -> Transducer:
    """After ``trigger``, the classes ``about`` within ``reach`` words get the factor."""
    arcs = []
    for left in range(reach + 1):
        on = max(0, left - 1)
        arcs.append({c: (on, c, factor if left and c in about else 1.0) for c in range(MET + 1)})
        arcs[-1][trigger] = (reach, trigger, 1.0)
    return Transducer(arcs)


def grammar() -> Transducer:
    plain = {c: (0, c, 1.0) for c in range(MET + 1)}
    target = _near(TARGET, (INSULT,), 1.5)
    negation = _near(NEGATION, (INSULT, MET), 0.4)
    reported = Transducer([plain | {REPORT: (1, REPORT, 1.0)}, {c: (1, c, 0.6 if c in (INSULT, MET) else 1.0) for c in range(MET + 1)}])
    # A threat waits for a target, which is then written as a met threat.
    threat = [plain | {THREAT: (REACH, OTHER, 1.0)}]
    for left in range(1, REACH + 1):
        threat.append({c: (left - 1, c, 1.0) for c in range(MET + 1)} | {THREAT: (REACH, OTHER, 1.0), TARGET: (0, MET, 1.0)})
    return Transducer(threat).compose(target).compose(negation).compose(reported)


class Lexicon(dict):
    """Words as (class, weight, stem), found in a trie of weighted stems and remembered."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.trie: dict = {}
        for stem, weight in stems.items():
            node = self.trie
            for letter in stem:
                node = node.setdefault(letter, {})
            node[""] = (INSULT, weight, stem)
        self.fixed = {w: (c, THREAT_WEIGHT if c == THREAT else 0.0, w) for c, ws in WORDS.items() for w in ws.split()}

    def __missing__(self, word: str) -> tuple[int, float, str] | None:
        node, found = self.trie, self.fixed.get(word)
        for letter in "" if found else f"{word}$":
            node = node.get(letter)
            if node is None:
                break
            found = node.get("", found)
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


FEATURES = 4


def features(text: str | None, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """Best clause, sum and mean over clauses, different stems; zeros if nothing is met."""
    low = (text or "").lower()
    words = _WORDS.findall(low)
    met = [x for x in map(lexicon.__getitem__, words) if x]
    if not any(x[0] in (INSULT, THREAT) for x in met):
        return [0.0] * FEATURES
    scores, stems = [], set()
    for clause in _CLAUSES.split(low):
        state, score, found = 0, 0.0, False
        for word in _WORDS.findall(clause):
            entry = lexicon[word]
            state, out, factor = machine.arcs[state][entry[0] if entry else OTHER]
            if out in (INSULT, MET):
                found = True
                score += factor * (entry[1] if out == INSULT else THREAT_WEIGHT)
                stems.add(entry[2])
        if found:
            scores.append(score)
    if not scores:
        return [0.0] * FEATURES
    total = sum(scores)
    return [max(scores), float(np.log1p(total)), total / np.sqrt(len(words) + 10.0), float(np.log1p(len(stems)))]


def whole_words(text: str) -> set[str]:
    """The words of a text with an end mark."""
    return {f"{w}$" for w in _WORDS.findall(text.lower()) if len(w) <= LONGEST_WORD}


def beginnings(text: str, known: Container[str]) -> set[str]:
    """Beginnings of the words of a text that are not known."""
    words = {w for w in _WORDS.findall(text.lower()) if f"{w}$" not in known}
    return {w[:k] for w in words for k in range(LEAST_STEM, min(len(w) - 1, LONGEST_STEM) + 1)}


def _counting(stems_of: Callable[[str], set[str]]) -> Callable:
    def run(batches):
        """Document frequencies of stems in a task."""
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else other).update(stems_of(text))
        names = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([other[n] for n in names], pa.int64())],
            names=["stem", "toxic", "other"],
        )

    return run


def _weighed(sample: DataFrame, stems_of: Callable[[str], set[str]], n_toxic: int, n_other: int) -> dict[str, float]:
    """Stems that toxic documents hold more often than others by far: at most ``STEMS``."""
    counted = sample.mapInArrow(_counting(stems_of), "stem string, toxic long, other long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / (n_other + 1.0))
    weight = odds - CAUTION * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    best = counted.where(F.col("toxic") >= LEAST_TOXIC).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    return {row["stem"]: row["weight"] for row in best.orderBy(F.desc("weight"), "stem").limit(STEMS).select("stem", "weight").collect()}


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray, bias: float):
        self.stems, self.weights, self.bias = stems, weights, bias


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's steps."""
    full = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(full.shape[1])
    ridge = np.diag([*[penalty * len(x) / 100] * x.shape[1], 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (p - y) + ridge @ w
        curve = (full * (p * (1 - p) + 1e-9)[:, None]).T @ full + ridge
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


NOTHING_LEARNED = Model({}, np.array([0.3, 0.3, 0.3, 0.3]), -2.0)


def learned(texts: DataFrame) -> Model:
    """A model from (text, toxic), at most ``SAMPLE`` rows."""
    sample = written(texts.where("text is not null and toxic is not null").select("text", (F.col("toxic") == 1).alias("toxic")).dropDuplicates(["text"]), "toxicity-sample")
    n = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return NOTHING_LEARNED
    words = _weighed(sample, whole_words, n[True], n[False])
    stems = words | _weighed(sample, lambda t: beginnings(t, words), n[True], n[False])
    rows = add_columns(sample, [F.col("text")], ", ".join(f"f{k} double" for k in range(FEATURES)), lambda: _featuring(stems), ["toxic"])
    table: pd.DataFrame = rows.toPandas()  # SAMPLE rows of numbers at most
    weights, bias = _logistic(table[[f"f{k}" for k in range(FEATURES)]].to_numpy(), table["toxic"].to_numpy().astype(float))
    return Model(stems, weights, bias)


def _featuring(stems: dict[str, float]):
    lexicon, machine = Lexicon(stems), grammar()

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = np.array([features(t.as_py(), lexicon, machine) for t in texts], float).reshape(-1, FEATURES)
        return [pa.array(found[:, k]) for k in range(FEATURES)]

    return compute


def _scoring(model: Model):
    featuring = _featuring(model.stems)

    def compute(texts: pa.Array) -> list[pa.Array]:
        x = np.column_stack([c.to_numpy() for c in featuring(texts)])
        score = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return compute


def labelled_sample(labels: DataFrame, by: int = 5, most: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of at most ``most`` labelled rows whose remainder is not 0, the smallest by a hash of the id."""
    usable = labels.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id"), by) != 0)
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def scored(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` with ``held_out``, ``score`` and ``predicted``."""
    ids = labelled_sample(labels).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select(named(doc_id).alias("_doc"), named(text).cast("string").alias("text"))
    model = learned(rows.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("text", "toxic"))
    marked = docs.withColumn("held_out", remainder(named(doc_id), 5) == 0)
    return add_columns(marked, [named(text).cast("string")], "score double, predicted int", lambda: _scoring(model), None if keep is None else [*keep, "held_out"])
