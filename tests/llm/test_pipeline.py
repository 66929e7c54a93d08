"""The pipeline against a brute-force version of each stage on what its predecessor kept."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from revlens.llm import quality_knn
from tests.conftest import SF0001, SF001
from tests.llm import test_minhash, test_packing, test_quality_rules


@pytest.mark.parametrize("sf", [SF001])
def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
        got = stage(spark, now, sf)
        assert got.columns == docs.columns
        if name == "quality_classifier":
            model = quality_knn.fit(now, spark.read.parquet(f"{sf}/labels.parquet"))
            score = np.concatenate([quality_knn.vote(model, x) for _, _, x in quality_knn.counts(pa.array([r["text"] for r in rows]))])
            want = [r for r, s in zip(rows, score) if s >= 0.3]
        elif name == "quality_rules":
            verdict = test_quality_rules.brute([(r["doc_id"], r["text"], r["lang"]) for r in rows])
            want = [r for r in rows if verdict[r["doc_id"]][-1]]
        else:
            component = test_minhash.brute([(r["doc_id"], r["text"]) for r in rows], 80)  # the stage links at 0.8
            want = [r for r in rows if component[r["doc_id"]][1] == r["doc_id"]]
        assert len(want) < len(rows)
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == {r["doc_id"]: r["text"] for r in want}
        rows = want
    packed = corpus_pipeline.run(spark, sf).collect()
    test_packing.check(packed, [(r["doc_id"], r["text"]) for r in rows])


def test_edge_rows(spark):
    text = " ".join(f"word{i} the of and" for i in range(80))
    rows = [(1, None), (2, ""), (None, text), (None, text), (3, text), (3, text), (4, text + " end"), (5, "x " * 30_000)]
    docs = spark.createDataFrame([(k, t, "en", None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF0001)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "None", "None"]
    odd = docs.selectExpr("*", "map('a', 1) AS m", "1 AS _row", "2 AS _")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, odd, SF0001).collect()) == ["1", "2", "3", "5", "None", "None"]
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, SF0001), docs.limit(0)
        assert stage(spark, empty, SF0001).collect() == []
    assert docs.count() >= 0


def test_near_copies_from_similarity_080(spark):
    """The stage links at 0.8, on documents with pairs between 0.8 and 0.85, and so does the whole pipeline."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(k for k, (_, c) in test_minhash.brute(rows, 80).items() if k == c)
    assert len(want) < sum(k == c for k, (_, c) in test_minhash.brute(rows, 85).items())
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF001).collect()) == want
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF001)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    component = test_minhash.brute(rows, 80)
    test_packing.check(corpus_pipeline.run(spark, SF001).collect(), [(k, t) for k, t in rows if component[k][1] == k])


def test_unlike_texts_under_one_key_all_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, "x"), (5, b, "x"), (9, b + " end", "x"), (7, a, "x"), (5, a, "x"), (5, c, "x"), (6, None, "x"), (6, "", "x"), (8, " ", "x"),
            (None, c, "x"), (None, c, "x")] + [(4, f"{c} tail{i // 2}", "y") for i in range(6)] + [(1, " ".join(f"t{i}w{j}" for j in range(20)), "z") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF0001).collect()]
    assert sorted(t for k, t in got if k == 1) == sorted(t for k, t, _ in rows if k == 1)
    assert sorted(t for k, t in got if k == 5) == [a, b]
    assert len([t for k, t in got if k == 4 and t.startswith(c)]) == 1
    assert sorted(str(k) for k, _ in got if k not in (1, 4, 5)) == ["6", "8", "None", "None"]
