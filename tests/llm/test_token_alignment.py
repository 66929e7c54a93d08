"""Cross-tokenizer alignment against a brute-force version: offsets by decoding, links by nested loops, counts by dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from revlens.llm import queries
from revlens.llm import token_alignment as ta
from tests.conftest import SF001

PATH_A, PATH_B = public_tokenizers.path(queries.TOKENIZER), public_tokenizers.path(queries.PIECE_TOKENIZER)
MODEL_A, MODEL_B = open(PATH_A, encoding="utf-8").read(), open(PATH_B, "rb").read()
TOK = Tokenizer.from_file(PATH_A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
ALPHABET = ta.byte_alphabet()
ODD = ["▁", "a▁b", "é\x1c \n\n  b'll don't 12 345", "　 中文 \U0001f600\x00", "<|endoftext|> <s> </s> <unk> <0x41>", " lead", "  two", "end ", "\t\ttab",
       "日本語テキスト" * 30, "́x", "ﬁ ½ Å", "a" * 500, "\U0001f600" * 200, "x" + " " * 300 + "y"]


def bytes_b(i):
    p = SP.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode()


def groups(text):
    """[(A ids, B ids)] of a text; None where a tokenizer does not give it back."""
    want = (" " + (text or "")).encode()
    if not text:
        return []
    a = [(i, bytes(ALPHABET[c] for c in TOK.id_to_token(i))) for i in TOK.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes_b(i)) for i in SP.encode(text)]
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    out, i, j, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):  # take from the side that lags behind
        if at_a <= at_b and i < len(a):
            own[0].append(a[i][0])
            at_a, i = at_a + len(a[i][1]), i + 1
        else:
            own[1].append(b[j][0])
            at_b, j = at_b + len(b[j][1]), j + 1
        if at_a == at_b and own[0] and own[1]:
            out.append(own)
            own = ([], [])
    return out


def brute(docs):
    cut = [groups(t) for _, t in docs]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in cut]
    count = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (key, _), g, own in zip(docs, cut, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def rows(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert rows(queries.QUERIES["op12_token_alignment"](spark, SF001)) == brute(docs)


@pytest.mark.parametrize("wide, batch", [(4096, 2000), (3, 4)])
def test_edge_rows(docs_of, monkeypatch, wide, batch):
    docs = [(1, None), (1, ""), (None, "Some words"), (2, "Some words"), (2, "Some words"), *((10 + i, t) for i, t in enumerate(ODD))]
    monkeypatch.setattr(ta, "WIDE", wide)
    monkeypatch.setattr(ta, "BATCH_ROWS", batch)
    assert rows(ta.alignments(docs_of(docs).repartition(3), MODEL_A, MODEL_B)) == brute(docs)
    assert ta.alignments(docs_of([]), MODEL_A, MODEL_B).collect() == []


def test_expansion_by_distinct_ids_equals_that_by_occurrences(monkeypatch):
    rng = np.random.default_rng(3)
    n_a, n_b = rng.integers(1, 30, 60), rng.integers(1, 30, 60)
    a, b = rng.integers(0, 9, n_a.sum()), rng.integers(0, 7, n_b.sum())
    doc = np.sort(rng.integers(0, 5, 60))
    got = {}
    for wide in (1 << 40, 100, 0):
        monkeypatch.setattr(ta, "WIDE", wide)
        got[wide] = [x.tolist() for x in ta.expand(a, b, n_a, n_b, doc, 7)]
    assert got[1 << 40] == got[100] == got[0]
    assert sum(got[0][2]) == int((n_a * n_b).sum())


def test_parts_of_long_texts_give_the_same_pieces():
    B = ta.PieceTokens(MODEL_B)
    assert B.blank_leads
    rnd = random.Random(4)
    bits = ["the", " ", " ", "  ", "\n", "é", "中", "word", ".", "▁", "don't", "\t", "a b c"]
    for k in range(300):
        text = "".join(rnd.choice(bits[: 9 if k % 3 else 13]) for _ in range(200))
        assert B.long_ids(text, 20) == SP.encode(text), repr(text)
    assert len(B.parts("some words " * 100, 20)) > 10


def test_a_text_without_common_ends_is_one_group():
    of = lambda *x: np.array(x, np.int64)
    assert ta.cuts(of(0, 0, 0), of(0), of(2), of(6)) == ([3], [1])
    assert ta.cuts(of(), of(), of(2), of(6)) == ([], [])
