"""Nearest-neighbour classifier: votes against brute force, held-out quality, edge rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from revlens.llm import quality_knn as knn
from revlens.llm import queries

SF01 = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = queries.QUERIES["op8_quality_knn"](spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for y, s, _ in held if y == v] for v in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.995  # area under the curve
    assert np.mean([p for y, _, p in held if y == 1]) > 0.995
    assert np.mean([p for y, _, p in held if y == 0]) < 0.15


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    scores = lambda x: {r["doc_id"]: r["score"] for r in knn.quality_scores(docs, x).collect()}
    assert scores(labels) == scores(flipped)


def test_votes_against_brute_force():
    texts = [f"word{i % 7} Common, text {'!!' * (i % 3)} {i}" * (1 + i % 5) for i in range(300)]
    x = np.concatenate([v for _, _, v in knn.counts(pa.array(texts))])
    model = knn.train(x[:200], np.arange(200) % 3 % 2)
    got = knn.vote(model, x[200:])
    for row, s in zip(x[200:], got):
        v = knn.weigh(row[None], model.idf)[0] @ model.axes
        cos = sorted(((float(v @ w) / float(np.linalg.norm(v)), y) for w, y in zip(model.vectors, model.labels)), reverse=True)[:knn.NEIGHBOURS]
        weights = [max(c, 0) ** 4 for c, _ in cos]
        assert s == pytest.approx(sum(w * y for w, (_, y) in zip(weights, cos)) / sum(weights), rel=1e-3)


def test_counts_do_not_depend_on_neighbours():
    texts = ["a b", None, "", "x" * 5_000_000, "A! b", "  \n", "é " * 700] + ["t " * i for i in range(700)]
    whole = np.concatenate([v for _, _, v in knn.counts(pa.array(texts))])
    for i in (0, 1, 3, 6, 300, 706):
        assert (whole[i] == np.concatenate([v for _, _, v in knn.counts(pa.array([texts[i]], pa.string()))])[0]).all()


def test_edge_rows(spark, docs_of):
    rows = [(1, None), (1, ""), (None, "good words"), (2, "good words"), (3, "bad" * 100_000), (4, "bad bad"), (5, "good")]
    labels = spark.createDataFrame([(2, 1, 9), (4, 0, 9), (4, 1, 9), (5, None, 9), (None, 1, 9), (3, 7, 9), (77, 1, 9)], "doc_id long, quality int, text int")
    got = knn.quality_scores(docs_of(rows), labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in knn.quality_scores(docs_of(rows), labels.limit(0)).collect()} == {0.5}
    assert knn.quality_scores(docs_of([]), labels).collect() == []
    kept = knn.keep(docs_of(rows), knn.fit(docs_of(rows), labels.limit(0)))
    assert kept.columns == docs_of(rows).columns and kept.count() == len(rows)


def test_training_holds_two_copies_of_the_counts_at_most():
    import tracemalloc
    x = np.random.default_rng(1).poisson(0.05, (3_000, knn.WIDTH)).astype(np.float32)
    tracemalloc.start()
    knn.train(x, np.arange(len(x)) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * x.nbytes  # beside the counts themselves
