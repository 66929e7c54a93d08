"""Chunked byte-level BPE against tiktoken on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest

from revlens.llm import bpe, queries
from tests.conftest import SF001

RANKS = open(public_tokenizers.path(queries.RANKS), "rb").read()


def whole(text):
    return bpe.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary(text or "")


def test_query_against_tiktoken(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.QUERIES["op9_bpe"](spark, SF001).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, text = whole(rows[r["doc_id"]]), rows[r["doc_id"]] or ""
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def hard_texts():
    rnd = random.Random(3)
    alphabet = ["a", "B", "é", "ß", "中", "1", "²", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", " ", "'", "'s", "'re", "'LL", ".", "!!",
                "-", "​", "\U0001f600", "don't ", "the ", "they're", " \n "]
    yield from ("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 900))) for _ in range(150))
    yield from (" " * 500, "x" * 700, "\n" * 333 + "a", ("ab " * 300), "'" * 400, "1" * 500, " x" * 300 + " " * 200 + "y" * 300)


@pytest.mark.parametrize("chunk,overlap", [(16, 16), (40, 20), (100, 33)])
def test_small_chunks_give_the_ids_of_whole_texts(docs_of, chunk, overlap):
    texts = list(hard_texts())
    df = bpe.encode(docs_of(list(enumerate(texts))), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    got = {r["doc_id"]: r["ids"] for r in df.collect()}
    assert got == {i: whole(t) for i, t in enumerate(texts)}


def test_long_texts_are_cut_and_stitched(docs_of):
    text = "The words, they're 12 of  many\n\n" * 9_000 + "z" * 200_000 + " end"
    df = bpe.encode(docs_of([(1, text)]), RANKS, public_tokenizers.PATTERN)
    assert df.collect()[0]["ids"] == whole(text)


def test_edge_rows(docs_of):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b")]
    got = bpe.digests(docs_of(rows), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 0), ("1", 0), ("2", 2), ("2", 2), ("None", 2)]
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] == 1} == {(empty, empty)}
    assert bpe.digests(docs_of([]), RANKS, public_tokenizers.PATTERN).collect() == []
