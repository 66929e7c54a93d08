"""Deleted interpolation against a brute-force version on word lists."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from revlens.llm import lm_score, queries
from tests.conftest import SF001


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def counted(texts):
    words, pairs = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        words.update(w)
        pairs.update(zip(["start", *w], w))
    return words, pairs


def context(words, v):
    return words["end" if v == "start" else v]


def brute(rows):
    """doc_id -> (held_out, n, known, N, base, score); also the mixture weights."""
    fold = {k: zlib.crc32(str(k).encode()) % 10 for k, _ in rows}
    words, pairs = counted(t for k, t in rows if fold[k] > 0)
    rest, rest_pairs = counted(t for k, t in rows if fold[k] > 1)
    cells, n_rest = defaultdict(list), sum(rest.values())
    step = lambda p: 10 ** (-0.05 * round(-math.log10(p) / 0.05)) if p else 0.0
    for k, t in rows:
        if fold[k] == 1:
            w = tokens(t)
            for v, x in zip(["start", *w], w):
                c = context(rest, v)
                cells[c.bit_length()].append((step(rest_pairs[v, x] / max(c, 1)), step(rest[x] / n_rest), 1 / (len(rest) + 1)))
    weights, last = {}, [0, 0.5, 0.5]
    for b in range(lm_score.BUCKETS):
        if cells[b]:
            last = [1 / 3] * 3 if b else [0, 0.5, 0.5]
            grouped = Counter(cells[b])
            for _ in range(200):
                new = [0.0] * 3
                for p, n in grouped.items():
                    s = sum(x * y for x, y in zip(p, last))
                    for i in range(3):
                        new[i] += n * p[i] * last[i] / s / len(cells[b])
                last = new
            last = [max(x, f) for x, f in zip(last, (0, 1e-6, 1e-6))]
            last = [x / sum(last) for x in last]
        weights[b] = last
    n, v, out = sum(words.values()), len(words), {}
    for k, t in rows:
        w = tokens(t)
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, x in zip(["start", *w], w):
            c = context(words, a)
            m = weights[c.bit_length()]
            score += math.log10(m[0] * pairs[a, x] / max(c, 1) + m[1] * words[x] / n + m[2] / (v + 1))
        out[k] = (fold[k] == 0, len(w), sum(words[x] > 0 for x in w), n, base, score)
    return out, weights


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART", 40_000)  # several parts
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want, weights = brute(rows)
    got = queries.QUERIES["op4_deleted_interpolation"](spark, SF001).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
        assert r["score"] == pytest.approx(want[r["doc_id"]][5], rel=2e-4)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than the base on unseen texts


def test_batches_and_parts_do_not_change_scores(docs_of, monkeypatch):
    rows = [(i, f"a b c w{i % 7} d w{i % 11}" * (i % 4)) for i in range(300)]
    sort = lambda s: sorted(tuple(r) for r in s.documents.collect())
    one = sort(lm_score.lm_scores(docs_of(rows)))
    monkeypatch.setattr(lm_score, "PART", 50)
    many = sort(lm_score.lm_scores(docs_of(rows)))
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert all(a == pytest.approx(b, rel=1e-9) for x, y in zip(one, many) for a, b in zip(x[5:], y[5:]))


def test_probabilities_of_the_next_token_sum_to_one(docs_of):
    """Over all known words, the end and one unknown word, after a known and after an unknown word."""
    rows = [(i, "x y z x y " * (1 + i % 3)) for i in range(1, 60)]
    probes = ["x", "y", "z", "", "never"]
    for head in ("y", "strange"):
        train = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 10]
        held = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 10 == 0]
        docs = train + [(held[0], head)] + [(k, f"{head} {p}") for k, p in zip(held[1:], probes)]
        s = lm_score.lm_scores(docs_of(docs))
        by = {r["doc_id"]: r["score"] for r in s.documents.collect()}
        words, pairs = counted(t for _, t in train)
        n, v = sum(words.values()), len(words)
        first = s.weights[len(train).bit_length()]
        p_head = first[0] * pairs["start", head.encode()] / len(train) + first[1] * words[head.encode()] / n + first[2] / (v + 1)
        w = s.weights[words[head.encode()].bit_length()]
        total = 0
        for x in (b"x", b"y", b"z", "end", b"never"):
            total += w[0] * pairs[head.encode(), x] / max(words[head.encode()], 1) + w[1] * words[x] / n + w[2] / (v + 1)
        assert total + (0 if words[head.encode()] else w[0]) == pytest.approx(1)
        end = w[0] * pairs[head.encode(), "end"] / max(words[head.encode()], 1) + w[1] * words["end"] / n + w[2] / (v + 1)
        assert by[held[0]] == pytest.approx(math.log10(p_head) + math.log10(end), rel=1e-9)


def test_edge_rows(docs_of):
    rows = [(1, None), (1, ""), (2, " \n"), (None, "a b"), (3, "A a" * 50_000), (4, "é")]
    got = lm_score.lm_scores(docs_of(rows)).documents.collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"]) for r in got) == sorted(
        (str(k), k is None or zlib.crc32(str(k).encode()) % 10 == 0, len(tokens(t))) for k, t in rows)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    none = lm_score.lm_scores(docs_of([(None, "a b"), (None, None)])).documents.collect()
    assert [(r["train_tokens"], r["base_score"], r["score"]) for r in none] == [(0, 0.0, 0.0)] * 2
    assert lm_score.lm_scores(docs_of([])).documents.collect() == []


def test_memory_of_a_worker_per_token():
    """Opening, asking, answering, counting and scoring a batch of a million tokens hold some small arrays besides them."""
    n, per, rng = 1_000_000, 500, np.random.default_rng(4)
    ids = (rng.zipf(1.3, n) % 60_000).astype(np.uint32)
    stored = {"counts": lm_score.packed(np.full(n // per, per, np.uint32)), "ids": lm_score.packed(ids),
              "words": lm_score.packed(lm_score.mix(np.arange(60_000, dtype=np.uint64)))}
    batch = pa.Table.from_pylist([stored | {"batch": 1, "role": 1, "keys": list(range(n // per))}])

    def most(run):
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1] / n
        finally:
            tracemalloc.stop()

    x, bytes_opened = most(lambda: lm_score.opened(**stored))
    asked = []
    for kind, keys, place in ((lm_score.WORDS, x.words, x.word), (lm_score.PAIRS, x.pairs, x.pair)):
        lists = {"keys": lm_score.packed(np.diff(keys, prepend=np.uint64(0))),
                 "counts": lm_score.packed(np.bincount(place).astype(np.uint32))}
        asked.append(pa.Table.from_pylist([lists | {"kind": kind, "part": 0, "batch": b, "role": b} for b in (1, 2)]))
    answers, bytes_answered = most(lambda: [lm_score._answer(t) for t in asked])
    mine = pa.concat_tables(answers)
    mine = mine.filter(pa.compute.equal(mine["batch"], 1))
    size = lm_score.Size(2 * (n + n // per), len(x.words))
    cells, bytes_cells = most(lambda: lm_score._cells(size)(batch, mine))
    mixture = lm_score.weights([tuple(r.values()) for r in cells.to_pylist()], size)
    scores, bytes_scored = most(lambda: lm_score._scored(size, mixture)(batch, mine))
    assert sum(cells["n"].to_pylist()) == n + n // per
    assert scores["n_known"].to_pylist() == [per + 1] * (n // per)
    assert max(bytes_opened, bytes_answered, bytes_cells, bytes_scored) < 80, (bytes_opened, bytes_answered, bytes_cells, bytes_scored)


def test_tasks_grow_with_the_tokens(spark, docs_of, monkeypatch):
    """Answers and scores are dealt to a task for every few parts, not to a fixed number."""
    monkeypatch.setattr(lm_score, "PART", 50)
    monkeypatch.setattr(lm_score, "TASK_PARTS", 4, raising=False)
    rows = [(i, f"a b c w{i % 7} d w{i % 11}") for i in range(300)]  # 2,100 tokens: 42 parts
    out = lm_score.lm_scores(docs_of(rows)).documents
    dealt = re.findall(r"Exchange hashpartitioning\(batch#\d+L, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt == ["11", "11"]
