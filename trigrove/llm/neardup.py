"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its ``width``-word shingles. Its sketch holds the ``SKETCH`` smallest hash values.
Documents with equal sets form a class without any comparison; only classes are compared.

* Candidates. Inverted lists hold the classes that have a run of neighbouring retained values in common (five at
  a similarity of 0.85). Two sets of similarity s keep a run of r values from one of its places with probability
  s ** r. Sets of up to ``ALL_PLACES`` shingles enter every run of theirs; then a pair at the threshold has a common
  one for certain, as so few different values cannot break all runs (``run_lengths``). Larger sets enter the runs that
  begin at a value divisible by four, some 30 of them. A run is rarely common to documents that only share a passage.
* A list is not multiplied out. The center of a list is the class that meets most others in all its lists, in a
  group of near copies the one they come from or nearly. Each class is first compared with one center, the one it
  shares most lists with. Where a list then still holds classes of several groups, the sketches of those outside its largest
  group stream past all its sketches, in blocks, and only pairs whose estimate passes leave the task. Two classes
  that are already in one group need no comparison: it could not change the groups. Of the pairs that pass, each class
  takes the likeliest for each group it could join, until none is left, so no pair is skipped.
* Pairs are filtered by the similarity that the union of the two sketches estimates (more than six deviations
  below the threshold fail; sets of up to ``SKETCH`` are known whole), and then confirmed on the full sets.

Tables between the steps are written to the shared folder. Nothing about single documents passes through the driver.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and kept; texts of fewer
words are one shingle; equal rows are linked like other copies; a row without id can be linked, but the id of
its group is the smallest there is (null if none), and it is kept only if no row of the group has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigrove.llm import words as W
from trigrove.llm.batches import named, packed, unpacked
from trigrove.llm.components import components
from trigrove.plans.shared import written

SKETCH = 256
PLACES = 128
SHORT_SET = 16
ALL_PLACES = 150
DEVIATIONS = 6
BLOCK = 1024
_OPEN = np.iinfo(np.int32).max
ROWS_PER_CENTER = 256


def _mark(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A key of a row: rows of equal id and text share it."""
    return F.xxhash64(named(doc_id).cast("string"), named(text).cast("string"))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    cut = W.words(data, offsets, W.SPACED)
    hashes = cut.hashes()
    shingles, starts = W.windows(hashes, cut.of, width, 3)
    sets = []
    for i, n in enumerate(cut.counts().tolist()):
        if n >= width:
            found = np.sort(shingles[starts[i] : starts[i + 1]])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif n:
            own = hashes[cut.of[i] : cut.of[i + 1]]
            sets.append(W.windows(own, np.array([0, n]), n, 100 + n)[0])
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def run_lengths(percent: int) -> tuple[int, int]:
    """How many neighbouring values two different sets of the similarity must have in common: (any sets, unions of up to ``SHORT_SET``).

    Of u values in the union at most (100 - percent) % are in one set only; they cut the others into one run more than they are."""

    def certain(u: int) -> int:
        single = (100 - percent) * u // 100
        return -(-(u - single) // (single + 1))

    small = [certain(u) for u in range(1, SHORT_SET + 1) if (100 - percent) * u >= 100]
    return min(certain(u) for u in range(SHORT_SET + 1, 4 * ALL_PLACES)), min(small, default=SHORT_SET)


def _runs(kept: np.ndarray, n: int, lengths: tuple[int, int]) -> np.ndarray:
    """Keys of the inverted lists: runs of neighbouring retained values."""
    keys = []
    if n >= lengths[0]:
        kept = kept[: ALL_PLACES if n <= ALL_PLACES else PLACES]
        whole = W.windows(kept, np.array([0, len(kept)]), lengths[0], 50)[0]
        keys.append(whole if n <= ALL_PLACES else whole[(kept[: len(whole)] & np.uint64(3)) == 0])
    if lengths[1] <= n <= SHORT_SET:
        keys.append(W.windows(kept, np.array([0, len(kept)]), lengths[1], 60)[0])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def class_of(values: np.ndarray) -> int:
    """A 64-bit name of a set, by two sums over it."""
    sums = np.sum(values, keepdims=True) + np.uint64(3) * np.sum(W.mix(values), keepdims=True)
    return int(W.mix(sums + np.uint64(len(values))).view(np.int64)[0])


def _sketching(width: int, lengths: tuple[int, int]):
    def run(batches):
        seen: set[int] = set()  # classes of this task: copies need no second sketch
        for batch in batches:
            data, offsets = W.utf8(batch.column(2))
            classes, sizes, sketches, keys = [], [], [], []
            for a, b in W.slices(offsets):
                for values in shingle_sets(data, offsets[a : b + 1], width):
                    n = len(values)
                    name = class_of(values) if n else None
                    classes.append(name)
                    sizes.append(n)
                    if n and name not in seen:
                        seen.add(name)
                        kept = values[:SKETCH]
                        sketches.append(((kept >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32))
                        keys.append(np.unique(_runs(kept, n, lengths)).view(np.int64))
                    else:
                        sketches.append(None)
                        keys.append(None)
            arrays = [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["mark", "id", "class", "n", "sketch", "keys"])

    return run


class Held:
    """Sketches of the classes outside a list's largest group, against which a list's sketches are held."""

    def __init__(self, percent: int):
        self.least = percent / 100
        self.names, self.roots, self.sketches = [], [], []

    def add(self, name: int, root: int, sketch: np.ndarray) -> None:
        self.names.append(name)
        self.roots.append(root)
        self.sketches.append(sketch)

    def close(self) -> None:
        self.sizes = np.array([len(s) for s in self.sketches])
        self.values = np.concatenate(self.sketches)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(self.values, kind="stable")
        self.sorted, self.owner = self.values[order], owner[order]
        self.ends = np.cumsum(self.sizes)
        self.last = np.where(self.sizes < SKETCH, _OPEN, self.values[self.ends - 1])
        self.name, self.root = np.array(self.names), np.array(self.roots)

    def similar(self, name: int, root: int, sketch: np.ndarray) -> list[tuple[int, int, float]]:
        """(held class, its root, estimate) of those of other groups that may reach the similarity."""
        low, high = np.searchsorted(self.sorted, sketch), np.searchsorted(self.sorted, sketch, side="right")
        counts = high - low
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        found = np.flatnonzero((self.root != root) & (self.name != name) & (both >= 0.5 * self.least * np.minimum(self.sizes, len(sketch))))
        if not len(found):
            return []
        last = _OPEN if len(sketch) < SKETCH else int(sketch[-1])
        out = []
        if last == _OPEN:
            whole = found[self.last[found] == _OPEN]
            union = self.sizes[whole] + len(sketch) - both[whole]
            for k, u in zip(*(x[both[whole] >= self.least * union - 1e-9].tolist() for x in (whole, union)), strict=True):
                out.append((int(self.name[k]), int(self.root[k]), float(both[k] / u)))
            found = found[self.last[found] < _OPEN]
        for k in found.tolist():
            own = self.values[self.ends[k] - self.sizes[k] : self.ends[k]]
            n = np.searchsorted(own, last, side="right") if last < self.last[k] else len(own)
            m = np.searchsorted(sketch, self.last[k], side="right") if self.last[k] < last else len(sketch)
            union = n + m - both[k]
            slack = DEVIATIONS * np.sqrt(self.least * (1 - self.least) / union)
            if both[k] >= (self.least - slack) * union - 1e-9:
                out.append((int(self.name[k]), int(self.root[k]), float(both[k] / union)))
        return out


def _meeting(percent: int):
    """Rows (key, block of held, block of others, role, class, root, sketch) in that order; held classes come first.
    Role 0: held, and met by the others like them; 1: only held; 2: only met."""

    def run(batches):
        where, held, waiting, sent = None, None, [], set()

        def meet(rows):
            for name, root, sketch in rows:
                for other, its, estimate in held.similar(name, root, sketch):
                    if (name, other) not in sent and (other, name) not in sent:
                        if len(sent) > 1 << 20:
                            sent.clear()
                        sent.add((name, other))
                        yield name, other, root, its, estimate

        for batch in batches:
            links = []
            keys, qs, ms, roles, names, roots = (batch.column(i).to_pylist() for i in range(6))
            column = batch.column(6)
            flat, offsets = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            for i, role in enumerate(roles):
                if where != (keys[i], qs[i], ms[i]):
                    if waiting:  # a list of held classes only
                        held.close()
                        links.extend(meet(waiting))
                    where, held, waiting, closed = (keys[i], qs[i], ms[i]), Held(percent), [], False
                row = (names[i], roots[i], flat[offsets[i] : offsets[i + 1]])
                if role < 2:
                    held.add(*row)
                    if role == 0:
                        waiting.append(row)
                elif held.names:
                    if not closed:
                        held.close()
                        links.extend(meet(waiting))
                        waiting, closed = [], True
                    links.extend(meet([row]))
            yield _link_batch(links)
        if waiting:
            held.close()
            yield _link_batch(list(meet(waiting)))

    return run


def _link_batch(links: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], kind) for k, kind in enumerate(kinds)], names=["a", "b", "root_a", "root_b", "estimate"])


def _comparing(width: int, percent: int):
    """Rows sorted by (center, salt, member): the center's set is held, its members stream past."""

    def run(batches):
        center, held = None, None
        for batch in batches:
            home, salt, member = (batch.column(i).to_pylist() for i in range(3))
            data, offsets = W.utf8(batch.column(3))
            links = []
            for a, b in W.slices(offsets):
                for i, values in enumerate(shingle_sets(data, offsets[a : b + 1], width), a):
                    if member[i] is None:
                        center, held = (home[i], salt[i]), values
                    elif center == (home[i], salt[i]):
                        both = len(np.intersect1d(held, values, assume_unique=True))
                        if 100 * both >= percent * (len(held) + len(values) - both):
                            links.append((home[i], member[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


class NearDuplicates:
    """The steps over one table. ``percent``: the least similarity, in hundredths; ``width``: words in a shingle."""

    def __init__(self, docs: DataFrame, *, doc_id: str, text: str, width: int, percent: int):
        self.percent, self.width = percent, width
        self.docs = docs.select(_mark(docs, doc_id, text).alias("mark"), named(doc_id).alias("id"), named(text).cast("string").alias("text"))
        id_type = self.docs.schema["id"].dataType.simpleString()
        self.rows = written(
            self.docs.mapInArrow(_sketching(width, run_lengths(percent)), f"mark long, id {id_type}, class long, n long, sketch array<int>, keys array<long>"), "sketches"
        )

    def _lists(self) -> DataFrame:
        """(key, class, size): members of inverted lists with more than one class."""
        entries = self.rows.where("keys is not null").select("class", F.explode("keys").alias("key"))
        lists = entries.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("size")).where("least < most")
        return written(entries.join(lists.select("key", "size"), "key"), "lists")

    @staticmethod
    def _stars(lists: DataFrame) -> DataFrame:
        """(a, b): each class b with the center a that it shares most lists with."""
        meets = lists.groupBy("class").agg(F.sum("size").alias("meets"))
        centers = lists.join(meets, "class").groupBy("key").agg(F.max(F.struct("meets", "class")).alias("most")).select("key", F.col("most.class").alias("center"))
        shared = lists.join(centers, "key").where("class <> center").groupBy("class", "center").count()
        best = shared.groupBy("class").agg(F.max(F.struct("count", "center")).alias("best"))
        return best.select(F.col("best.center").alias("a"), F.col("class").alias("b"))

    def _members(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(class, n, sketch) and (class, text) of the classes in ``lists``."""
        wanted = lists.select("class").distinct()
        sketches = self.rows.where("sketch is not null").join(wanted, "class")
        one = sketches.groupBy("class").agg(F.min("mark").alias("mark"))
        facts = written(sketches.join(one, ["class", "mark"]).select("class", "n", "sketch").dropDuplicates(["class"]), "classes")
        texts = written(self.docs.select("mark", "text").join(one, "mark").select("class", "text").dropDuplicates(["class"]), "texts")
        return facts, texts

    def _likely(self, pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches allow the similarity."""
        side = lambda s: facts.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        close = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
        whole = F.greatest("n_a", "n_b") <= SKETCH
        looked = F.when(whole, F.col("union")).otherwise(F.slice("union", 1, SKETCH))
        both = F.size(F.array_intersect("looked", F.array_intersect("sketch_a", "sketch_b")))
        part = self.percent / 100
        least = F.when(whole, part).otherwise(part - DEVIATIONS * (part * (1 - part) / SKETCH) ** 0.5)
        estimated = sized.where(close).withColumn("union", union).withColumn("looked", looked)
        return estimated.where(both >= least * F.size("looked") - 1e-9).select("a", "b")

    def _confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs whose full sets have the similarity. A center with many members is compared in several tasks."""
        pairs = written(pairs, "pairs")
        load = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / ROWS_PER_CENTER).alias("salts"))
        salted = pairs.join(load, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
        members = salted.select(F.col("b").alias("class"), F.col("a").alias("home"), "salt", F.col("b").alias("member"))
        centers = load.select(
            F.col("a").alias("class"), F.col("a").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
            F.lit(None).cast("long").alias("member"),
        )
        sent = members.union(centers).join(texts, "class").select("home", "salt", "member", "text")
        sorted_ = sent.repartition("home", "salt").sortWithinPartitions("home", "salt", F.col("member").asc_nulls_first())
        return written(sorted_.mapInArrow(_comparing(self.width, self.percent), "a long, b long"), "links")

    def roots(self) -> DataFrame:
        """(node, root) of every class that is linked with another."""
        lists = self._lists()
        facts, texts = self._members(lists)
        groups = components(self._confirmed(self._likely(self._stars(lists), facts), texts))
        left = written(self._across(lists, groups, facts), "met")
        while not left.isEmpty():
            likeliest = left.groupBy("a", "root_b").agg(F.max(F.struct("estimate", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
            links = self._confirmed(likeliest, texts)
            groups = components(groups.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links))
            asked = left.join(likeliest, ["a", "b"], "left_anti").select("a", "b", "estimate")
            left = written(self._apart(asked, groups), "met")
        return groups

    @staticmethod
    def _rooted(df: DataFrame, groups: DataFrame, column: str, root: str) -> DataFrame:
        named_groups = groups.select(F.col("node").alias(column), F.col("root").alias("_root"))
        return df.join(named_groups, column, "left").withColumn(root, F.coalesce("_root", column)).drop("_root")

    def _apart(self, pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of classes in different groups, with their roots."""
        both = self._rooted(self._rooted(pairs, groups, "a", "root_a"), groups, "b", "root_b")
        return both.where("root_a <> root_b").select("a", "b", "root_a", "root_b", "estimate")

    def _across(self, lists: DataFrame, groups: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs of classes in one list and in different groups whose sketches allow the similarity."""
        rooted = self._rooted(lists.select("key", "class").distinct(), groups, "class", "root")
        shares = rooted.groupBy("key", "root").count()
        mixed = shares.groupBy("key").agg(F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("members"), F.count("*").alias("roots"))
        mixed = mixed.where("roots > 1").select(
            "key", F.col("main.root").alias("main"), F.ceil(F.col("members") / BLOCK).alias("ms"), F.ceil((F.col("members") - F.col("main.count")) / BLOCK).alias("qs")
        )
        rows = rooted.join(mixed, "key").withColumn("held", F.col("root") != F.col("main")).drop("main")
        one = (F.col("ms") == 1) & (F.col("qs") == 1)
        zero = F.lit(0).cast("long")
        blocks = lambda n: F.sequence(zero, F.col(n) - 1)
        q, m = F.pmod(F.xxhash64("class"), F.col("qs")), F.pmod(F.xxhash64("class"), F.col("ms"))
        small = rows.where(one).select("key", zero.alias("q"), zero.alias("m"), F.when(F.col("held"), 0).otherwise(2).alias("role"), "class", "root")
        large = rows.where(~one)
        held = large.where("held").select("key", q.alias("q"), F.explode(blocks("ms")).alias("m"), F.lit(1).alias("role"), "class", "root")
        others_ = large.select("key", F.explode(blocks("qs")).alias("q"), m.alias("m"), F.lit(2).alias("role"), "class", "root")
        sent = small.union(held).union(others_).join(facts.select("class", "sketch"), "class").select("key", "q", "m", "role", "class", "root", "sketch")
        ordered = sent.repartition("key", "q", "m").sortWithinPartitions("key", "q", "m", "role")
        found = ordered.mapInArrow(_meeting(self.percent), "a long, b long, root_a long, root_b long, estimate double")
        return found.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("a", "b", "root_a", "root_b", "estimate")).alias("p")).select("p.*")

    def grouped(self) -> DataFrame:
        """(mark, id, n, group) of every row; group is the smallest id of its group, of any row without shingles its own id."""
        classes = self.rows.where("n > 0").groupBy("class").agg(F.min("id").alias("least"))
        rooted = self._rooted(classes, self.roots(), "class", "root")
        smallest = rooted.groupBy("root").agg(F.min("least").alias("group"))
        named_classes = rooted.join(smallest, "root").select("class", "group")
        full = self.rows.select("mark", "id", "class", "n").join(named_classes, "class", "left")
        return full.select("mark", "id", "n", F.when(F.col("n") > 0, F.col("group")).otherwise(F.col("id")).alias("group"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``kept``."""
    found = NearDuplicates(docs, doc_id=doc_id, text=text, width=width, percent=percent).grouped()
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("group").alias("component_id"), F.col("id").eqNullSafe(F.col("group")).alias("kept"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; rows without shingles all stay."""
    found = NearDuplicates(docs, doc_id=doc_id, text=text, width=width, percent=percent).grouped()
    stay = found.where(F.col("id").eqNullSafe(F.col("group"))).select(F.col("mark").alias("_mark"), (F.col("n") == 0).alias("_blank")).distinct()
    marked = docs.select(packed(docs.columns), _mark(docs, doc_id, text).alias("_mark"))
    kept = marked.join(stay, "_mark")
    first = kept.where("not _blank").dropDuplicates(["_mark"])
    return first.unionByName(kept.where("_blank")).select(*unpacked(docs.columns))
