"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Legal is an optional system turn and then user and assistant in turn, ending with an assistant, or nothing
at all. A row is kept, given another role, deleted, or has empty user and assistant rows inserted before it;
blank and repeated rows must go, a truncated row that stays costs extra (``COSTS``). Rows become symbols
(initial of the role, fault); equal neighbours are one run. A symbol is a min-plus matrix over the four states
of the legal order, a run is passed by the cached binary powers of that matrix, and the choices are then
unrolled from the first row on, of equally cheap ones always the least letter (D, I, K, R).

How it is spread: symbols travel without texts, equal rows counted together. They are sorted by conversation
and place over range partitions, so that a conversation may lie over any number of them. A partition cuts
conversations into chunks of ``CHUNK`` rows. A conversation inside one chunk is solved on the spot; of longer
ones only one matrix a chunk meets in one place, which gives each chunk the cost of what follows it and the
state before it. Texts are shuffled once, to where the edits of their conversation are, and pass by in order,
one at a time. All rows of one conversation pass through one task there, since its digest is one chain.

Defined results: a null role or text is read as one space, so such a row is blank or has no legal role. Rows come
by turn, nulls first, those of one turn by role and then by a hash of the text. A null id is a conversation like
any other. Repeated rows are faults. Of extra columns those with the names of new ones are left out, the
others follow their rows and are null on inserted ones. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from trigrove.llm.batches import named, others
from trigrove.plans.shared import written

CHUNK = 1 << 16
BATCH = 4096

#: Fixed values.
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
SPACES = " \t\n\v\f\r"

INITIALS = "sua"  # a fourth kind is any other role
CLEAN, CUT, AGAIN, BLANK = range(4)

#: States of the legal order: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ALTERNATE = (USER, USER, ASSISTANT, USER)
ROLE_AT = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
FAR = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), FAR) for j in range(4)) for row in a)


def before(a: Matrix, v: Vector) -> Vector:
    """The cost of each state if ``a`` has to be passed first and then ``v`` is to be paid."""
    return tuple(min(min(x + y for x, y in zip(row, v, strict=True)), FAR) for row in a)


_ONE: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
_INSERT: Matrix = tuple(tuple(COSTS["I"] if j == ALTERNATE[i] else FAR for j in range(4)) for i in range(4))
_INSERTS: Matrix = tuple(map(lambda *rows: tuple(map(min, *rows)), _ONE, _INSERT, times(_INSERT, _INSERT)))
#: The cost of each state at the end of a conversation: what has to be inserted yet.
LAST: Vector = before(_INSERTS, (0, FAR, FAR, 0))


def choices(symbol: int, state: int) -> dict[str, tuple[int, int]]:
    """Letters of the edits of one row in a state, with their costs and the states after them."""
    initial, fault = symbol % 4, symbol // 4
    found = {"D": (COSTS["D"], state)}
    if fault < AGAIN:
        more = TRUNCATED_COST if fault == CUT else 0
        if (state, initial) in _KEPT:
            found["K"] = (COSTS["K"] + more, _KEPT[state, initial])
        found["R"] = (COSTS["R"] + more, ALTERNATE[state])
    return found


@lru_cache(None)
def power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2^bit rows of one symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    one = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for cost, to in choices(symbol, state).values():
            one[state][to] = min(one[state][to], cost)
    return times(_INSERTS, tuple(map(tuple, one)))


def bits(n: int) -> Iterator[int]:
    return (k for k in range(n.bit_length()) if n >> k & 1)


def run_before(symbol: int, n: int, v: Vector) -> Vector:
    for bit in bits(n):
        v = before(power(symbol, bit), v)
    return v


def whole(runs: Sequence[tuple[int, int]]) -> Matrix:
    """The matrix of a chunk."""
    found = _ONE
    for symbol, n in runs:
        for bit in bits(n):
            found = times(found, power(symbol, bit))
    return found


@lru_cache(1 << 16)
def _row(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """Least letters among the cheapest for one row, the cost of what follows given from its least value on."""
    letters, costs = "", before(power(symbol, 0), after)
    left = costs[state]
    while True:
        fit = {c: (cost, to) for c, (cost, to) in choices(symbol, state).items() if cost + after[to] == left}
        if COSTS["I"] + costs[ALTERNATE[state]] == left:
            fit["I"] = (COSTS["I"], ALTERNATE[state])
        letter = min(fit)
        letters += letter
        left -= fit[letter][0]
        state = fit[letter][1]
        if letter != "I":
            return letters, state


@lru_cache(1 << 16)
def _one_before(symbol: int, after: Vector) -> tuple[Vector, int]:
    v = before(power(symbol, 0), after)
    least = min(v)
    return tuple(min(x - least, FAR) for x in v), least


def unrolled(runs: Sequence[tuple[int, int]], state: int, after: Vector, last: bool) -> tuple[str, int]:
    """Edits of a chunk from ``state`` on and the state after it; ``after`` is the cost of what follows, ``last`` adds the inserts at the end."""
    ends = [after]
    for symbol, n in reversed(runs):
        ends.append(run_before(symbol, n, ends[-1]))
    parts = []
    for (symbol, n), v in zip(runs, ends[-2::-1], strict=True):
        if symbol // 4 >= AGAIN:  # nothing to choose, and inserts come later
            parts.append("D" * n)
            continue
        least = min(v)
        costs = [tuple(min(x - least, FAR) for x in v)]
        for _ in range(n - 1):
            costs.append(_one_before(symbol, costs[-1])[0])
        for follows in reversed(costs):
            letters, state = _row(symbol, state, follows)
            parts.append(letters)
    while last and LAST[state]:
        parts.append("I")
        state = ALTERNATE[state]
    return "".join(parts), state


@dataclass
class Chunk:
    """Rows of one conversation that lie together in one partition."""

    key: tuple
    runs: list[list[int]] = field(default_factory=list)
    n_rows: int = 0
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    turns: int = 0
    first: int = -1
    last: int = -1
    least: int | None = None
    most: int | None = None

    def add(self, symbol: int, n: int) -> None:
        initial = symbol % 4
        if self.last >= 0 and not _legal(self.last, initial):
            self.illegal += 1
        self.illegal += n - 1
        self.first = initial if self.first < 0 else self.first
        self.last = initial
        self.faults[symbol // 4] += n
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def at(self, turn: int | None) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn


def _legal(a: int, b: int) -> bool:
    return (a, b) in {(0, 1), (1, 2), (2, 1)}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _counts(faults: Sequence[int], illegal: int, turns: int, least: int | None, most: int | None, cost: int) -> list[int]:
    gaps = 0 if least is None else most - least + 1 - turns
    return [gaps, faults[BLANK], faults[AGAIN], faults[CUT], illegal, cost]


def symbols(rows: DataFrame) -> DataFrame:
    """(c, t, r, h) with how many rows are equal there, the symbol of the first and that of the others. No texts."""
    bare = F.rtrim("x", F.lit(SPACES))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(INITIALS) for v in (c, i)]), F.substring("r", 1, 1)), F.lit(3))
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), CLEAN).otherwise(CUT)
    counted = (
        rows.select("c", "t", "r", "h", "n", (initial + 4 * fault).alias("symbol"))
        .groupBy("c", "t", "r", "h").agg(F.sum("n").alias("n"), F.first("symbol").alias("symbol"))
    )
    # A text that a conversation holds at several turns is a fault but for the first of them.
    held = counted.groupBy(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("h").alias("h2")).agg(
        F.min(F.struct(F.col("t").isNotNull().alias("a"), "t")).alias("first"), F.count(F.lit(1)).alias("places")
    ).where("places > 1").select("c2", "r2", "h2", F.col("first.t").alias("t2"))
    marked = counted.join(held, F.col("c").eqNullSafe(F.col("c2")) & (F.col("r") == F.col("r2")) & (F.col("h") == F.col("h2")), "left")
    again = F.when(F.col("symbol") >= 4 * BLANK, F.col("symbol")).otherwise(F.col("symbol") % 4 + 4 * AGAIN)
    first = F.when(F.col("r2").isNull() | F.col("t").eqNullSafe(F.col("t2")), F.col("symbol")).otherwise(again)
    return marked.select("c", "t", "r", "h", "n", first.cast("int").alias("one"), again.cast("int").alias("more"))


_CHUNK = (
    "place long, open boolean, n_rows long, faults array<long>, illegal long, turns long, least long, most long, first int, last int, "
    "symbols array<int>, sizes array<long>, matrix array<long>, edits string, cost long"
)


def _cutting(types: pa.Schema, chunk_rows: int) -> Callable:
    def run(batches):
        part = TaskContext.get().partitionId()
        done: list[tuple[Chunk, bool]] = []
        made, now, opened, first = 0, None, True, True

        def flush():
            nonlocal made
            out = [_chunk_row(c, (part << 32) + made + i, is_open) for i, (c, is_open) in enumerate(done)]
            made += len(done)
            done.clear()
            return pa.RecordBatch.from_pylist(out, schema=types)

        for batch in batches:
            for c, t, r, h, n, one, more in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if now is None or now.key[0] != c:
                    if now is not None:
                        done.append((now, opened))
                    # The first and the last conversation of a partition may go on in its neighbours.
                    now, opened, first = Chunk((c, t, r, h)), first, False
                elif now.n_rows >= chunk_rows:
                    done.append((now, True))
                    now, opened = Chunk((c, t, r, h)), True
                now.n_rows += 1
                now.at(t)
                now.add(one, 1)
                if n > 1:
                    now.add(more, n - 1)
            if len(done) >= BATCH:
                yield flush()
        if now is not None:
            done.append((now, True))
        if done:
            yield flush()

    return run


def _chunk_row(c: Chunk, place: int, is_open: bool) -> dict:
    edits, cost = (None, None) if is_open else (unrolled(c.runs, START, LAST, True)[0], _solved(c.runs))
    return dict(zip("ctrh", c.key, strict=True)) | {
        "place": place, "open": is_open, "n_rows": c.n_rows, "faults": c.faults, "illegal": c.illegal, "turns": c.turns, "least": c.least, "most": c.most,
        "first": c.first, "last": c.last, "symbols": [s for s, _ in c.runs] if is_open else [], "sizes": [n for _, n in c.runs] if is_open else [],
        "matrix": [x for row in whole(c.runs) for x in row] if is_open else [], "edits": edits, "cost": cost,
    }


def _solved(runs: Sequence[Sequence[int]]) -> int:
    v = LAST
    for symbol, n in reversed(runs):
        v = run_before(symbol, n, v)
    return v[START]


def _joined(batches):
    """Of the chunks of each long conversation: its counts, and the cost of what follows each chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            chunks = row["chunks"]
            v, after = LAST, []
            for k in reversed(chunks):
                after.append(v)
                v = before(tuple(tuple(k["matrix"][4 * i : 4 * i + 4]) for i in range(4)), v)
            faults = [sum(k["faults"][i] for k in chunks) for i in range(4)]
            between = list(zip(chunks, chunks[1:], strict=False))
            illegal = sum(k["illegal"] for k in chunks) + sum(not _legal(a["last"], b["first"]) for a, b in between)
            numbered = [k for k in chunks if k["least"] is not None]
            turns = sum(k["turns"] for k in numbered) - sum(a["most"] == b["least"] for a, b in zip(numbered, numbered[1:], strict=False))
            ends = (numbered[0]["least"], numbered[-1]["most"]) if numbered else (None, None)
            counts = _counts(faults, illegal, turns, *ends, v[START])
            places = [{"place": k["place"], "after": list(a), "final": i == 0} for i, (k, a) in enumerate(zip(reversed(chunks), after, strict=True))]
            yield pa.RecordBatch.from_pylist([{"counts": counts, "places": places}], schema=pa.schema([
                ("counts", pa.list_(pa.int64())),
                ("places", pa.list_(pa.struct([("place", pa.int64()), ("after", pa.list_(pa.int64())), ("final", pa.bool_())]))),
            ]))


def _from_each_state(batches):
    """Edits of each chunk of a long conversation from every state, and the states after them."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            runs = list(zip(row["symbols"], row["sizes"], strict=True))
            found = [unrolled(runs, state, tuple(row["after"]), row["final"]) for state in range(4)]
            out.append({"edits": [e for e, _ in found], "ends": [s for _, s in found]})
        made = [pa.array([o["edits"] for o in out], pa.list_(pa.string())), pa.array([o["ends"] for o in out], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "all_edits", "ends"])


def solved(rows: DataFrame, chunk_rows: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Chunks (c, t, r, h, place, edits, state) and, for each conversation, its counts and costs."""
    spark = rows.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = symbols(rows)
    placed = narrow.repartitionByRange(n_parts, "c", "t", "r", "h").sortWithinPartitions("c", "t", "r", "h")
    key_fields = [f for f in narrow.schema.fields if f.name in ("c", "t", "r", "h")]
    schema = StructType([StructField(f.name, f.dataType, True) for f in key_fields] + StructType.fromDDL(_CHUNK).fields)
    chunks = written(placed.mapInArrow(_cutting(to_arrow_schema(schema), chunk_rows), schema), "conversation-chunks")
    shut, opened = chunks.where("not open"), chunks.where("open")
    gaps = F.when(F.col("least").isNull(), 0).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns"))
    short = shut.select("c", gaps.cast("long").alias("gaps"), F.col("faults")[BLANK].alias("blank"), F.col("faults")[AGAIN].alias("duplicate"),
                        F.col("faults")[CUT].alias("truncated"), "illegal", "cost")
    parts = F.sort_array(F.collect_list(F.struct("place", "matrix", "faults", "illegal", "turns", "least", "most", "first", "last")))
    met = opened.groupBy("c").agg(parts.alias("chunks"))  # one matrix and a few numbers for each chunk
    result = "counts array<long>, places array<struct<place: long, after: array<long>, final: boolean>>"
    ways = written(_beside(met, ["c"], "chunks", _joined, result), "conversation-costs")
    long = ways.select("c", *[F.col("counts")[i].alias(n) for i, n in enumerate(COUNTS)])
    follows = ways.select(F.explode("places").alias("p")).select("p.*").withColumnRenamed("place", "place2")
    asked = opened.join(follows, opened["place"] == F.col("place2")).select("c", "t", "r", "h", "place", "symbols", "sizes", "after", "final")
    tried = written(asked.mapInArrow(_from_each_state, StructType(asked.schema.fields + StructType.fromDDL("all_edits array<string>, ends array<int>").fields)), "conversation-edits")
    chained = tried.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("place", "ends"))).alias("chain"))
    zero = F.struct(F.lit(START).alias("state"), F.array().cast("array<struct<place: bigint, state: int>>").alias("seen"))
    walk = F.aggregate("chain", zero, lambda acc, x: F.struct(
        F.get(x["ends"], acc["state"]).alias("state"),
        F.concat(acc["seen"], F.array(F.struct(x["place"].alias("place"), acc["state"].alias("state")))).alias("seen"),
    ))
    states = chained.select(F.explode(walk["seen"]).alias("s")).select(F.col("s.place").alias("place2"), F.col("s.state").alias("state"))
    long_edits = tried.join(states, tried["place"] == F.col("place2")).select("c", "t", "r", "h", "place", F.get("all_edits", F.col("state")).alias("edits"), "state")
    edits = shut.select("c", "t", "r", "h", "place", "edits", F.lit(START).alias("state")).unionByName(long_edits)
    return edits, short.unionByName(long)


def _beside(df: DataFrame, keep: Sequence[str], reads: str, work: Callable, schema: str) -> DataFrame:
    """``work`` over one column, row by row, the columns ``keep`` beside its results."""
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                for made in work([one.select([reads])]):
                    yield pa.RecordBatch.from_arrays([*(one.column(k) for k in keep), *made.columns], names=[*keep, *made.schema.names])

    return df.mapInArrow(run, StructType([*fields, *StructType.fromDDL(schema).fields]))


MADE = ("edit", "new_role", "new_text")


def repaired(
    df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, chunk_rows: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` and inserted ones, and counts for each conversation.

    Rows come with ``edit`` (D, I, K or R), ``new_role`` and ``new_text`` (null on deleted rows). All rows of a conversation
    are in one partition, in order. ``copies`` counts how often a row stands there (once, unless given).
    Conversations come as ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``.
    """
    kept = [c for c in others(df, MADE)]
    rows = df.select(
        named(conv_id).alias("c"), named(turn).cast("long").alias("t"), F.coalesce(named(role).cast("string"), F.lit(" ")).alias("r"),
        F.coalesce(named(text).cast("string"), F.lit(" ")).alias("x"), (F.lit(1) if copies is None else copies).cast("int").alias("n"),
        *[named(c).alias(f"k{i}") for i, c in enumerate(kept)],
    ).withColumn("h", F.unhex(F.sha2("x", 256)))
    edits, counted = solved(rows, chunk_rows)
    extra = {f"k{i}": f for i, f in enumerate(rows.schema.fields[5:-1])}
    plan = edits.select("c", "t", "r", "h", F.lit(0).alias("kind"), "edits", "state", F.lit(None).cast("string").alias("x"), F.lit(0).alias("n"))
    texts = rows.select("c", "t", "r", "h", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), F.lit(0).alias("state"), "x", "n", *extra)
    both = texts.unionByName(plan, allowMissingColumns=True)
    ordered = both.repartition("c").sortWithinPartitions("c", "t", "r", "h", "kind").select("c", "kind", "edits", "state", "r", "x", "n", *extra)
    carried = [StructField(c, df.schema[c].dataType, True) for c in kept]
    schema = StructType([*carried, *StructType.fromDDL("edit string, new_role string, new_text string").fields])
    id_place = kept.index(conv_id) if conv_id in kept else -1
    counted = counted.select(F.col("c").alias(conv_id), *COUNTS)
    return ordered.mapInArrow(_applying(len(kept), id_place, [*kept, *MADE]), schema), counted


def _applying(n_kept: int, id_place: int, names: list[str]) -> Callable:
    """Pairs the rows of each conversation with its edits as they pass by."""

    def run(batches):
        state, letters, at, conversation = START, "", 0, ()
        for batch in batches:
            take, changes = [], []  # row of the batch or -1, and (edit, role, text)
            owner = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for i, (c, kind, edits, begin, r, x, n) in enumerate(zip(*columns, strict=True)):
                if conversation != (c,) or kind == 0:
                    # Left over are the inserts at a conversation's end: they belong to the one before this row.
                    for _ in letters[at:]:
                        state = ALTERNATE[state]
                        take.append(-1)
                        owner.append(conversation[0])
                        changes.append(("I", ROLE_AT[state], ""))
                    state, letters, at, conversation = begin, edits or "", 0, (c,)
                    if kind == 0:
                        continue
                for _ in range(n):
                    while letters[at] == "I":
                        state = ALTERNATE[state]
                        take.append(-1)
                        owner.append(c)
                        changes.append(("I", ROLE_AT[state], ""))
                        at += 1
                    letter = letters[at]
                    at += 1
                    take.append(i)
                    owner.append(c)
                    if letter == "D":
                        changes.append(("D", None, None))
                    elif letter == "R":
                        state = ALTERNATE[state]
                        changes.append(("R", ROLE_AT[state], x))
                    else:
                        state = _KEPT[state, INITIALS.index(r[0])]
                        changes.append(("K", r, x))
            if take:
                yield _out(batch, take, owner, changes, n_kept, id_place, names)
        if letters[at:]:
            changes = []
            for _ in letters[at:]:
                state = ALTERNATE[state]
                changes.append(("I", ROLE_AT[state], ""))
            yield _out(batch, [-1] * len(changes), [conversation[0]] * len(changes), changes, n_kept, id_place, names)

    return run


def _out(batch: pa.RecordBatch, take: list[int], owner: list, changes: list[tuple], n_kept: int, id_place: int, names: list[str]) -> pa.RecordBatch:
    index = pa.array(np.array(take), mask=np.array(take) < 0)
    kept = [batch.column(7 + i).take(index) for i in range(n_kept)]
    if id_place >= 0:
        kept[id_place] = pa.array(owner, kept[id_place].type)
    return pa.RecordBatch.from_arrays([*kept, *(pa.array([c[k] for c in changes], pa.string()) for k in range(3))], names=names)


def digest(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, audit, repaired_sha256) of what ``repaired`` gave, computed as its rows pass by."""
    read = rows.select(named(conv_id), "edit", F.concat("new_role", F.lit(":"), "new_text"))
    kind = read.schema.fields[0].dataType
    schema = StructType([StructField(conv_id, kind, True), *StructType.fromDDL("audit string, repaired_sha256 string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, letters, chain, begun = (), [], None, False
        out: list[tuple] = []
        for batch in batches:
            for c, edit, line in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if now != (c,):
                    if now:
                        out.append((now[0], "".join(letters), chain.hexdigest()))
                    now, letters, chain, begun = (c,), [], hashlib.sha256(), False
                letters.append(edit)
                if line is not None:
                    chain.update(f"\n{line}".encode() if begun else line.encode())
                    begun = True
            if len(out) >= BATCH:
                yield _rows(out, arrow)
                out = []
        if now:
            out.append((now[0], "".join(letters), chain.hexdigest()))
        if out:
            yield _rows(out, arrow)

    return read.mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults put in by crc32 of "conv_id:turn" modulo 20: 0 drops a row, 1 empties its text,
    2 takes its ``[.!?]`` away, 3 repeats it, 4 makes the role user. Nulls are read as one space, but for the order of turns."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    role = F.when(fault == 4, "user").otherwise(spaced["role"])
    made = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("copies"), fault.alias("fault"))
    return made.where("fault <> 0").drop("fault")
