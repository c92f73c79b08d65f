"""Token ids of a corpus in binary files: ids ranked by frequency, in whole bytes, lengths apart in control bytes.

A text is encoded by a tokenizer of the ``tokenizers`` library and gets an end id. Ids are counted over all texts and replaced by
their ranks, so that the commonest 256 take one byte and the next 65,280 two. Two bits tell a rank's length; four of them are one
control byte. Documents lie in ascending order of their ids, range partition after range partition, a file each:

    file     blocks, then the footer; each is followed by a line feed
    block    "TIDB", number of documents (4 bytes), ids before it in this file (8), sizes of the next parts (8 each: names, control, data),
             size of each document's name (4; -1 for none), number of each document's ids (8), names (UTF-8), control bytes, data bytes
    footer   "TIDF", number of the file (4), ids in the file (8)

Numbers are little-endian, those of the footer big-endian. Control bytes of a document start anew; unused bits are 0. ``ranks`` holds the
id of each rank as a table. Files are written by Spark's own writer, so a lost task leaves none behind, and read as whole binary files.
``IDS_PER_FILE`` bounds them, and ``MOST_FILES`` their number.

A text is encoded in pieces where the tokenizer's own splitting cannot reach across, for byte-level BPE with its usual pattern: before white space that
follows something else, after a single line feed, and between a Latin letter and a mark. Pieces met before are remembered (the first ``MEMO`` of them in a
worker), new ones are encoded many at a time with line feeds between them. Other tokenizers, and texts with special tokens or rare white space, are encoded whole.

Defined results: a null or empty text is the end id alone. Documents without an id come first; those of one id by the CRC-32 of their ids.
Repeated rows are documents of their own. Extra columns are not read. An empty table gives a file without documents and an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from trigrove.llm.batches import named
from trigrove.llm.words import slices
from trigrove.plans.shared import new_folder

IDS_PER_FILE = 1 << 24
MOST_FILES = 1 << 18
IDS_PER_BLOCK = 1 << 18
MEMO = 300_000
LONGEST_REMEMBERED = 24
AT_ONCE = 1 << 22
TOGETHER = 1000
END_ID = 0

#: Letters in every version of Unicode that has them.
_LATIN = "A-Za-zÀ-ÖØ-öø-ʯ"
_PIECES = re.compile(rf" ?[{_LATIN}]+(?![^\s.,;:!?])|\n(?=\S)|\s*\S+|\s+")
#: What only some call white space, and white space beyond ASCII.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A piece that can stand between line feeds.
_PLAIN = re.compile(r" ?\S+")

#: Lengths of the four numbers of each control byte, and what is kept of four bytes for each length.
SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
KEPT_BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


class Encoder:
    """Ids of texts, as little-endian bytes of ``kind``."""

    def __init__(self, path: str, specials_are_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        split, others = self.tokenizer.pre_tokenizer, (self.tokenizer.normalizer, self.tokenizer.truncation, self.tokenizer.padding)
        self.in_pieces = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space and others == (None, None, None)
        feed = self._encoded(["\n"])[0]
        self.feed = np.frombuffer(feed, self.kind)[0] if len(feed) == np.dtype(self.kind).itemsize else None
        # A special token may hold a space and is found in whole texts only.
        self.specials = [] if specials_are_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def _encoded(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, encoded as one text with line feeds between them, which have an id of their own."""
        ids = np.array(self.tokenizer.encode("\n".join(pieces), add_special_tokens=False).ids, self.kind)
        ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
        raw, width = ids.tobytes(), ids.itemsize
        return [raw[width * (s + 1) : width * e] for s, e in zip([-1, *ends[:-1]], ends, strict=True)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        plain = [p for p in pieces if _PLAIN.fullmatch(p)] if self.feed is not None else []
        made = {}
        for k in range(0, len(plain), TOGETHER):
            made.update(zip(part := plain[k : k + TOGETHER], self._together(part), strict=True))
        rest = [p for p in pieces if p not in made]
        return made | dict(zip(rest, self._encoded(rest), strict=True))

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        whole = [not self.in_pieces or any(s in t for s in self.specials) or _RARE_SPACE.search(t) is not None for t in texts]
        alone = iter(self._encoded([t for t, w in zip(texts, whole, strict=True) if w]))
        cut = [[] if w else _PIECES.findall(t) for t, w in zip(texts, whole, strict=True)]
        made = self._learn(list(set(chain.from_iterable(cut)).difference(self.memo)))
        room = MEMO - len(self.memo)
        if room > 0:  # common pieces come early
            self.memo.update(islice(((p, ids) for p, ids in made.items() if len(p) <= LONGEST_REMEMBERED), room))
        out = []
        for pieces, w in zip(cut, whole, strict=True):
            known = list(map(self.memo.get, pieces))
            if None in known:
                known = [made[p] if k is None else k for k, p in zip(known, pieces, strict=True)]
            out.append(next(alone) if w else b"".join(known))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoding(path: str, specials_are_text: bool, end_id: int, kind: pa.DataType) -> Callable:
    def run(batches):
        key = (path, specials_are_text)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(*key))  # kept by workers that take further tasks
        end = np.array([end_id], encoder.kind).tobytes()
        counts = np.zeros(1, np.int64)
        for batch in batches:
            sums = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            for a, b in slices(sums, AT_ONCE):
                ids = [e + end for e in encoder([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])]
                found = np.bincount(np.frombuffer(b"".join(ids), encoder.kind))
                if len(found) > len(counts):
                    counts, found = found, counts
                counts[: len(found)] += found
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.nulls(b - a, pa.binary())], names=["name", "ids", "counts"])
        if counts.any():  # of all ids of this task, in a row of their own
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["name", "ids", "counts"])

    return run


def _adding(batches):
    """The sum of counts, an id and its count in a row."""
    sums = np.zeros(1, np.int64)
    for batch in batches:
        for blob in batch.column(0):
            found = np.frombuffer(blob.as_py(), np.int64).copy()
            if len(found) > len(sums):
                sums, found = found, sums
            sums[: len(found)] += found
    held = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["id", "n"])


def packed(numbers: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers below 2^32, ``counts`` of each document."""
    numbers = numbers.astype("<u4")
    more = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    fours = (counts + 3) // 4
    lengths = np.zeros(4 * fours.sum(), np.uint8)
    lengths[np.arange(len(numbers)) + np.repeat(4 * (np.cumsum(fours) - fours) - (np.cumsum(counts) - counts), counts)] = more
    control = (lengths.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]].tobytes()


def unpacked(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of some documents, ``counts`` of each, whose control bytes lie one after the other."""
    fours = (counts + 3) // 4
    within = np.arange(4 * fours.sum()) - np.repeat(4 * (np.cumsum(fours) - fours), 4 * fours)
    size = SIZES[control].ravel()[within < np.repeat(counts, 4 * fours)]
    at = np.cumsum(size) - size
    room = np.concatenate([data, np.zeros(3, np.uint8)])
    value = room[at].astype(np.uint32)
    for k in (1, 2, 3):
        value |= room[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & KEPT_BITS[size]


def block(names: Sequence[str | None], counts: np.ndarray, control: bytes, data: bytes, before: int) -> bytes:
    raw = [b"" if n is None else n.encode() for n in names]
    text = b"".join(raw)
    sizes = np.array([-1 if n is None else len(r) for n, r in zip(names, raw, strict=True)], "<i4")
    head = b"TIDB" + np.array([len(names)], "<u4").tobytes() + np.array([before, len(text), len(control), len(data)], "<u8").tobytes()
    return b"".join([head, sizes.tobytes(), counts.astype("<u8").tobytes(), text, control, data])


def blocks(content: memoryview):
    """(ids before it in the file, names, counts, control, data) of every block of a file."""
    at = 0
    while bytes(content[at : at + 4]) == b"TIDB":
        n = int(np.frombuffer(content, "<u4", 1, at + 4)[0])
        before, n_text, n_control, n_data = (int(x) for x in np.frombuffer(content, "<u8", 4, at + 8))
        at += 40
        sizes, counts = np.frombuffer(content, "<i4", n, at), np.frombuffer(content, "<u8", n, at + 4 * n).astype(np.int64)
        at += 12 * n
        ends = np.cumsum(np.maximum(sizes, 0))
        names = [None if s < 0 else bytes(content[at + e - s : at + e]).decode() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        at += n_text
        control, data = np.frombuffer(content, np.uint8, n_control, at), np.frombuffer(content, np.uint8, n_data, at + n_control)
        at += n_control + n_data + 1
        yield before, names, counts, control, data


def _filing(ranks: np.ndarray, kind: str) -> Callable:
    def run(batches):
        """Blocks of the documents of a partition, in order, and the footer."""
        names, ids = [], []
        done = held = 0

        def made():
            counts = np.array([len(i) for i in ids], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([block(names, counts, *packed(ranks[np.concatenate(ids)], counts), done)], pa.binary())], names=["block"])

        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                names.append(name.as_py())
                ids.append(np.frombuffer(raw.as_py(), kind))
                held += len(ids[-1])
                if held >= IDS_PER_BLOCK:
                    yield made()
                    done, held, names, ids = done + held, 0, [], []
        if names:
            yield made()
        footer = b"TIDF" + TaskContext.get().partitionId().to_bytes(4, "big") + (done + held).to_bytes(8, "big")
        yield pa.RecordBatch.from_arrays([pa.array([footer], pa.binary())], names=["block"])

    return run


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, specials_are_text: bool = False,
    ids_per_file: int = IDS_PER_FILE,
) -> None:
    """Writes the ids of all texts to ``folder``. ``tokenizer`` is the place of its file on every executor."""
    spark = docs.sparkSession
    kind = Encoder(tokenizer).kind
    texts = docs.select(named(doc_id).alias("name"), named(text).cast("string").alias("text"))
    kept = new_folder(spark, "token-ids")
    schema = StructType([StructField("name", texts.schema["name"].dataType, True), *StructType.fromDDL("ids binary, counts binary").fields])
    encoded = texts.mapInArrow(_encoding(tokenizer, specials_are_text, end_id, to_arrow_schema(schema).field("name").type), schema)
    encoded.write.option("compression", "zstd").parquet(kept)
    found = spark.read.parquet(kept)
    sums = found.where("counts is not null").select("counts").mapInArrow(_adding, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = sums.orderBy(F.desc("n"), "id").toPandas()  # a row for each id in use: no more than the vocabulary
    order = counted["id"].to_numpy(np.int64)
    ranks = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    ranks[order] = np.arange(len(order))
    spark.createDataFrame([(list(map(int, order)),)], "ids array<int>").write.parquet(f"{folder}/ranks")
    n_files = min(MOST_FILES, int(counted["n"].sum()) // ids_per_file + 1)
    rows = found.where("ids is not null").select("name", "ids", F.crc32("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(n_files, "name", "tie", "row").sortWithinPartitions("name", "tie", "row")
    filed = ordered.select(F.col("name").cast("string"), "ids").mapInArrow(_filing(ranks, kind), "block binary")
    filed.select(F.col("block").cast("string").alias("value")).write.text(f"{folder}/files")


def _number(content: str, first: int, n: int):
    return F.conv(F.hex(F.substring(content, first, n)), 16, 10).cast("long")


def read_ids(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in ``folder``; ``start`` counts the ids of all documents before it, ``ids``
    are little-endian unsigned 32-bit numbers."""
    found = spark.read.format("binaryFile").load(f"{folder}/files")
    files = found.select("content", _number("content", -13, 4).alias("file"))
    sizes = found.select(_number("content", -13, 4).alias("of"), _number("content", -9, 8).alias("n"))
    before = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("of", F.coalesce(before, F.lit(0)).alias("start"))  # at most MOST_FILES rows of two numbers
    placed = files.join(F.broadcast(starts), F.col("file") == F.col("of")).select("content", "start")
    order = np.array(spark.read.parquet(f"{folder}/ranks").head()["ids"], np.uint32)
    rows = placed.mapInArrow(_reading(order), "doc_id string, start long, n_tokens long, ids binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(id_type))


def _reading(order: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for before, names, counts, control, data in blocks(memoryview(content.as_buffer())):
                    ids = order[unpacked(control, data, counts)].astype("<u4")
                    ends = np.cumsum(counts)
                    made = [ids[e - n : e].tobytes() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()), pa.array(start + before + ends - counts), pa.array(counts), pa.array(made, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return run
