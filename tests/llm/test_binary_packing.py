"""Power-of-two packing: ids against the tokenizers library, pieces against the binary digits, numbering and buckets."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from revlens.llm import binary_packing as bp
from revlens.llm import queries
from revlens.session import fresh_path
from tests.conftest import SF001

PATH = public_tokenizers.path(queries.WORD_TOKENIZER)
MODEL = open(PATH, encoding="utf-8").read()
TOK = Tokenizer.from_file(PATH)
BITS = ["a", "Bc", "the", "é", "É", "ß", "İ", "Σ", "1", "42", " ", " ", " ", "\n", "\t", "\x0b", "'s", "'RE", "'", ".", ",", "!!", "-", "—", "\x1c", "中", " ",
        " ", "́", "̸", "<", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "\x85", "\x00", "$$$", "\U0001f600", "=", "`", "~", "^", "_", ")", "\u0308"]


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def check(rows, docs, size=2048):
    """Rows are, as a multiset per key, the powers of two of each document's ids; one sequence each, numbered by length."""
    want = []
    for key, text in docs:
        ids, at = [*ids_of(text), 1], 0
        powers = [size] * (len(ids) // size) + [1 << k for k in range(size.bit_length() - 2, -1, -1) if len(ids) % size >> k & 1]
        for n in powers:
            want.append((key, at, n, zlib.crc32(np.array(ids[at: at + n], "<u4").tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    got = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["offset"] == 0 for r in rows)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    by_length = defaultdict(list)
    for r in rows:
        by_length[r["length"]].append((r["bucket_rank"], r["sequence_id"]))
    at = 0
    for n in sorted(by_length, reverse=True):  # a bucket is a run of numbers
        assert sorted(by_length[n]) == [(i, at + i) for i in range(len(by_length[n]))]
        at += len(by_length[n])


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    check(queries.QUERIES["op13_binary_packing"](spark, SF001).collect(), docs)


def test_ids_by_words_are_those_of_whole_texts():
    rnd = random.Random(5)
    enc = bp.WordEncoder(MODEL, known=100)  # forgets often
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["", None, " ", "a."]
    for at in range(0, len(texts), 500):
        part = texts[at: at + 500]
        ids, bounds = enc.group(pa.array(part, pa.large_string()))
        for t, a, b in zip(part, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == ids_of(t), repr(t)


def test_long_texts_in_parts():
    rnd = random.Random(6)
    for _ in range(40):
        text = "".join(rnd.choice(BITS) for _ in range(300))
        assert bp.WordEncoder(MODEL).long(text, 20).tolist() == ids_of(text)


def test_other_models_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Some  Words, and\n MORE"
    ids, bounds = bp.WordEncoder(open(path, encoding="utf-8").read()).group(pa.array([text, "x"], pa.large_string()))
    own = Tokenizer.from_file(path)
    assert ids[: bounds[1]].tolist() == own.encode(text, add_special_tokens=False).ids and len(bounds) == 3


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 2047, 2048, 2049, 6145])
def test_pieces_are_the_binary_digits(n):
    got = bp.binary_pieces(n, 2048)
    assert [s for s, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]
    assert sum(x for _, x in got) == n and all(x & (x - 1) == 0 for _, x in got)
    assert len(got) == n // 2048 + bin(n % 2048).count("1")


def test_edge_rows_and_files(spark, docs_of, monkeypatch):
    docs = [(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, "word " * 5_000), (4, "<|endoftext|> x")] + [(9 + i, "same text") for i in range(40)]
    check(bp.pack_documents(docs_of(docs), MODEL).collect(), docs)
    monkeypatch.setattr(bp, "TASK_BLOCK", 2)  # several blocks of tasks
    check(bp.pack_documents(docs_of(docs).repartition(7), MODEL, size=16).collect(), docs, 16)
    assert bp.pack_documents(docs_of([]), MODEL).collect() == []
    with pytest.raises(ValueError):
        bp.pack_documents(docs_of(docs), MODEL, size=100)
    path = fresh_path(spark, "buckets")
    bp.write_buckets(bp.pack_documents(docs_of(docs), MODEL, with_ids=True), path, batch_tokens=4096)
    rows = spark.read.parquet(path).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    held = defaultdict(int)
    for r in rows:
        held[r["length"], r["batch"]] += r["length"]
    assert max(held.values()) <= 4096
