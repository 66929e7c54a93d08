"""Cap filters against brute-force cosines."""

import math

import numpy as np
import pytest

from revlens.llm import cap_filters, queries
from tests.conftest import SF0001, SF001


def brute(rows, threshold=0.9):
    """Sorted (id, n_links, component, kept), each row a vertex."""
    ok = [k is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for k, v in rows]
    near = [[] for _ in rows]
    for i, (_, v) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and len(v) == len(rows[j][1]):
                a, b = np.array(v, np.float64), np.array(rows[j][1], np.float64)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            group, stack = [], [i]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    group.append(x)
                    stack += near[x]
            least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
            for x in group:
                out[x] = (rows[x][0], len(near[x]), least, rows[x][0] == least)
    return sorted(out, key=str)


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_query_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(queries.QUERIES["op10_cap_filters"](spark, sf)) == brute(rows)


def test_recall_at_the_threshold():
    """Pairs at 0.9 itself share a filter in more than 99 (from a billion vectors on 93) of 100 cases, whatever the size the filters are made for."""
    rng = np.random.default_rng(1)
    for n, pairs, least in ((1_000, 1500, 0.99), (100_000, 1500, 0.99), (5_000_000, 1500, 0.99), (10 ** 9, 400, 0.93), (10 ** 11, 200, 0.93), (10 ** 12, 200, 0.93)):
        x = rng.standard_normal((pairs, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal((pairs, 64))
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        (r, f), (s, g) = cap_filters.filters_of(x, n), cap_filters.filters_of(0.9 * x + math.sqrt(0.19) * z, n)
        assert len({a for a, _ in set(zip(r.tolist(), f.tolist())) & set(zip(s.tolist(), g.tolist()))}) > least * pairs


@pytest.mark.parametrize("d", [64, 384, 1024])
def test_the_codes_follow_the_number_of_vectors_without_a_cap(d):
    """The filters expected in common never fall below what was asked for."""
    for n in (10, 10 ** 5, 10 ** 9, 10 ** 10, 10 ** 11, 10 ** 12, 10 ** 13):
        assert cap_filters.shared_filters(n, d) > 0.97 * cap_filters.SHARED
        assert cap_filters.parameters(n, d)[3] <= cap_filters.WORDS


def test_codes_that_cannot_be_made_are_refused():
    with pytest.raises(ValueError):
        cap_filters.parameters(10 ** 14, 8, 0.5)


@pytest.mark.parametrize("parts", [2, 3])
def test_list_decoding_finds_all_codewords_of_the_cap(monkeypatch, parts):
    x = np.random.default_rng(2).standard_normal((50, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    height, codes, _, words = cap_filters.parameters(2_000, 20)
    monkeypatch.setattr(cap_filters, "parameters", lambda *a: (height, codes, parts, words))
    edges, want = [20 * k // parts for k in range(parts + 1)], set()
    for c, (turn, *own) in enumerate(cap_filters._codes(20, codes, parts, words)):
        y = x @ turn
        s = y[:, : edges[1]] @ own[0]
        for k in range(1, parts):  # scores of the whole product
            s = (s[:, :, None] + (y[:, edges[k]: edges[k + 1]] @ own[k])[:, None, :]).reshape(len(x), -1)
        want |= {(r, (20 * codes + c) * words ** parts + i) for r, i in zip(*np.nonzero(s >= height))}
    assert set(zip(*(v.tolist() for v in cap_filters.filters_of(x, 2_000)))) == want


def test_dense_group_over_many_blocks(spark, monkeypatch):
    """Blocks of a few rows give the same links as one."""
    monkeypatch.setattr(cap_filters, "BLOCK", 7)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((3, 24))
    rows = [(i, (centre[i % 3] + 0.22 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(cap_filters.near_duplicates(df)) == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]),
            (6, [1.0, None, 0.0]), (7, [inf, 0.0, 0.0]), (8, []), (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [1.0, 0.4, 0.0]),
            (11, [1e-30, 0.0, 0.0]), (12, [1e30, 1e29, 0.0]), (13, [1.0] * 16), (14, [1.0] * 15 + [0.5]), (15, [-1.0] * 16), (16, [0.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, id int, cls int, c string")
    assert result(cap_filters.near_duplicates(df)) == brute(rows)
    assert cap_filters.near_duplicates(df.limit(0)).collect() == []


def test_tables_that_grow_with_the_vectors_are_not_broadcast(spark, monkeypatch):
    """Whatever size Spark takes them for: it reads compressed files, and a salted table has sixteen copies of each row."""
    plans, write = {}, cap_filters.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(cap_filters, "materialize", lambda df, name: plans.update({name: plan(df)}) or write(df, name))
    rows = [(i, [float(i % 9 + 1), float(i % 5), 1.0]) for i in range(60)]
    out = cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert result(out) == brute(rows)
    for p in (plans["caps-groups"], plan(out)):
        assert p.count("SortMergeJoin") >= 2 and "Broadcast" not in p
