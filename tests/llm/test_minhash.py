"""SuperMinHash near-duplicates against a brute-force version on sets of word tuples."""

import random
from collections import defaultdict

import numpy as np
import pytest

from revlens.llm import minhash, queries
from revlens.llm.components import connected_components
from tests.conftest import SF0001, SF001


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, threshold=85):
    """doc_id -> (n, component) by comparing all documents that share a shingle."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    common = defaultdict(int)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= threshold * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.QUERIES["op7_minhash"](spark, sf)
    assert result(df) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect())


def test_families_of_near_copies_without_their_original(spark, docs_of):
    """Chains and families of edits: every component is found, also where the bucket's centre links with few."""
    rnd, rows, k = random.Random(5), [], 0
    for _ in range(6):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([40, 120, 150]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((k := k + 1, " ".join(w)))
        chain = list(base)
        for _ in range(12):
            chain = chain[3:] + [f"c{rnd.randrange(10**6)}" for _ in range(3)]
            rows.append((k := k + 1, " ".join(chain)))
    assert result(minhash.near_duplicates(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("block", [5, 1024])
def test_buckets_full_of_unlike_documents(spark, monkeypatch, block):
    """Bands of one row put documents of any similarity and size together: no pair of a bucket is left undecided."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.read.parquet(f"{SF0001}/documents.parquet")
    got = result(minhash.near_duplicates(df, threshold=60, bands=60, rows=1))
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], 60)


def test_links_by_difference():
    rng = np.random.default_rng(4)
    centre = np.arange(120)
    sets = [np.unique(np.append(rng.choice(centre, rng.integers(60, 120), replace=False), rng.integers(100, 400, rng.integers(0, 40))))
            for _ in range(60)]
    n, diff = np.array([len(s) for s in sets]), [np.setxor1d(s, centre) for s in sets]
    got = set(zip(*(x.tolist() for x in minhash.links_by_difference(n, diff, np.arange(40), np.arange(40, 60), 60))))
    want = {(i, j) for i in range(40) for j in range(40, 60)
            if 100 * len(set(sets[i]) & set(sets[j])) >= 60 * len(set(sets[i]) | set(sets[j]))}
    assert want and got == want


def test_edge_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a b c d e"), (7, "a b c d e f"), (8, long),
            (9, long + " x"), (None, "A b"), (11, "é É"), (12, "É É"), (13, "a b c d e"), (13, "a b"), (14, "x" * 70_000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                  for r in minhash.near_duplicates(docs_of(rows)).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False), (7, 2, 7, True),
            (8, 59996, 8, True), (9, 59997, 8, False), (None, 1, None, True), (11, 1, 11, True), (12, 1, 12, True),
            (13, 1, 4, False), (13, 1, 4, False), (14, 1, 14, True)]
    assert got == sorted(want, key=str)


def test_empty_table(docs_of):
    assert minhash.near_duplicates(docs_of([])).collect() == []


def test_signature_estimates_similarity_with_less_variance_than_minhash():
    rng, est = np.random.default_rng(0), []
    for _ in range(200):
        x = rng.integers(0, 2**63, 300, dtype=np.uint64)
        sig = minhash.superminhash(np.array([200, 200]), np.concatenate([x[:200], x[100:]]), 150)
        est.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(est) - 1 / 3) < 0.01
    assert np.std(est) < 0.9 * (2 / 9 / 150) ** 0.5


def test_signature_stops_early_with_the_same_values():
    """A set's signature is the least of its elements' signatures, which run through all ranks."""
    x = np.arange(40, dtype=np.uint64) * np.uint64(7919)
    one = minhash.superminhash(np.ones(40, int), x, 64)
    assert all(sorted(np.floor(r)) == list(range(64)) for r in one)  # a permutation each
    assert (minhash.superminhash(np.array([40]), x, 64)[0] == one.min(axis=0)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3), (300, 299), (299, 300)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 200 for i in range(200, 260)} | {299: 299, 300: 299}
    assert got == want


@pytest.mark.parametrize("texts, calls", [
    (["a b c d e f g"] * 3 + ["unlike words of another text here"], 1),
    ([" ".join(f"w{i}" for i in range(200))] + [" ".join(f"w{i}" for i in range(k, 200)) for k in (1, 2)], 1)])
def test_components_are_found_once_without_further_links(docs_of, monkeypatch, texts, calls):
    """Each search for components is some ten stages an iteration, which the driver keeps track of."""
    seen = []
    monkeypatch.setattr(minhash, "connected_components", lambda edges: seen.append(1) or connected_components(edges))
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert len(seen) == calls and found[0] == found[1] == found[2] == 0


def test_repeated_keys_join_their_classes_and_links(docs_of):
    near = [" ".join(f"w{i}" for i in range(k, 200)) for k in (0, 1)]
    rows = [(5, near[0]), (7, near[1]), (7, "another text of some more words"), (3, "another text of some more words"), (9, "alone it stands here now")]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(rows)).collect()}
    assert found == {3: 3, 5: 3, 7: 3, 9: 9}


@pytest.mark.parametrize("small_edges", [0, 50_000])
def test_components_are_the_same_with_salted_joins_and_with_broadcasts(spark, monkeypatch, small_edges):
    from revlens.llm import components
    monkeypatch.setattr(components, "SMALL_EDGES", small_edges)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000, i) for i in range(1000, 1040)] + [(None, 7), (9, None)]
    want = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    while True:
        new = dict(want)
        for a, b in edges:
            if a in new and b in new:
                new[a] = new[b] = min(new[a], new[b])
        if new == want:
            break
        want = new
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_minima_of_many_edges_are_not_broadcast(spark, monkeypatch):
    """Whatever size Spark takes them for: it reads compressed files, and a salted table has sixteen copies of each row."""
    from revlens.llm import components
    plans, write = [], components.materialize
    monkeypatch.setattr(components, "SMALL_EDGES", 0)
    monkeypatch.setattr(components, "materialize", lambda df, name, parts=None: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or write(df, name, parts))
    connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)


def test_small_component_steps_are_few_files(spark):
    """Not one file a shuffle partition, and no marker file: every file is made by processes of its own on a local disk."""
    from pathlib import Path

    from revlens import session
    made = session.scratch_mark()
    wide = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    folders = [Path(p.removeprefix("file:")) for p in session._made[made:]]
    assert len(folders) > 3 and not any((f / "_SUCCESS").exists() for f in folders)
    assert all(0 < len(list(f.glob("part-*"))) <= 16 for f in folders[1:])  # the first holds edges of unknown number
