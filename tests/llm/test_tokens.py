"""Token files: exact round trips, and the tokenizer's ids of whole texts."""

import random
import re
import zlib

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from trigrove.llm import tokens
from trigrove.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "", " ", "  ", "a b", " a  b ", "one\n two", "one \n two", "tab\t end\t", "I'm we'll 's 't", "x  y　 z  w", "\x1c \x1d\x85 a", "É漢字 ñ\x00x ÇA", "½ ² Ⅷ a½ ²b",
    "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", "emoji 👩‍👩‍👧 here", "é combining", "9 99 9.9", "a" * 300 + " " + "b" * 70, "... !!! ,,", "\n\n \n  x", "_under _score",
]


def encoded(texts, path=PATH):
    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    letters = "abcXYZ 0123  .,!'\n\t\r_é漢½  ​\x1f-"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcXYZ 01  .,!'\n\t_é漢½ł-") for _ in range(rng.randrange(60))) for _ in range(5000)] + [brute.sentence(500, 1)] * 2
    encoder = tokens.Encoder(PATH)
    assert encoder.in_pieces
    for part in (texts[:1000], texts[1000:], texts):
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder(part)] == [ids[:-1] for ids in encoded(part)]
    for text in texts:
        assert "".join(tokens._PIECES.findall(text)) == text
    rare = [c for c in map(chr, range(0x3100)) if re.match(r"\s", c) and not tokens._RARE_SPACE.match(c)]
    assert "".join(rare) == "\t\n\v\f\r "
    assert 50256 in encoded(["<|endoftext|>"])[0] and 50256 not in np.frombuffer(tokens.Encoder(PATH, True)(["<|endoftext|>"])[0], "<u2")


def test_numbers_of_every_length_come_back():
    rng = np.random.default_rng(1)
    for counts in ([0], [1], [4, 0, 5, 1, 3], [1000]):
        numbers = [rng.choice([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], n).astype(np.uint32) for n in counts]
        control, data = tokens.packed(np.concatenate(numbers), np.array(counts))
        found = tokens.unpacked(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.array(counts))
        assert found.tolist() == np.concatenate(numbers).tolist()
    assert [len(x) for x in tokens.packed(np.array([1, 300, 70_000, 1 << 30, 5]), np.array([5]))] == [2, 11]


@pytest.mark.parametrize("ids_per_file", [1 << 24, 5000])
def test_files_come_back(spark, tmp_path, ids_per_file):
    rows = brute.awkward() + [(100 + k, t, "en", "s") for k, t in enumerate(TEXTS)]
    tokens.write_ids(brute.table(spark, rows), f"{tmp_path}/ids", PATH, ids_per_file=ids_per_file)
    found = sorted(tokens.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r["start"])
    wanted = sorted(zip([r[0] for r in rows], encoded([r[1] for r in rows]), strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in found] == [w[0] for w in wanted]
    start = 0
    for r, (_, ids) in zip(found, wanted, strict=True):
        assert (r["start"], r["n_tokens"]) == (start, len(ids)) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    n_files = len(list((tmp_path / "ids/files").glob("part-*")))
    assert n_files == min(start // ids_per_file + 1, len(rows)) or ids_per_file < 1 << 24 and 10 < n_files <= start // ids_per_file + 1
    order = spark.read.parquet(f"{tmp_path}/ids/ranks").head()["ids"]
    counts = np.bincount([i for _, ids in wanted for i in ids])
    assert order == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([("b", "Some WORDS here"), (None, None), ("a", "more")], "name string, body string")
    tokens.write_ids(docs, f"{tmp_path}/ids", path, doc_id="name", text="body")
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokens.read_ids(spark, f"{tmp_path}/ids", "string").collect()}
    assert found == dict(zip([None, "a", "b"], encoded(["", "more", "Some WORDS here"], path), strict=True))


def test_nothing(spark, tmp_path):
    tokens.write_ids(brute.table(spark, []), f"{tmp_path}/ids", PATH)
    assert tokens.read_ids(spark, f"{tmp_path}/ids").count() == 0


def test_query_is_that_of_the_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, wanted = 0, []
    for d, ids in zip(docs, encoded([d["text"] for d in docs]), strict=True):
        wanted.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op12_token_ids"](spark, data).collect())) == wanted
