"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet and reads again as the next stage's ``docs``.
All but the last return the columns of ``documents``, with rows unchanged.

Defined results: rows are judged one by one, so null and repeated keys and
null or empty texts follow the operators' rules.  (An empty text fails the
base quality rule; of rows that repeat a key those with unlike texts all
stay; rows without a key are never duplicates.)  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import minhash, packing, quality_knn, quality_rules, queries
from revlens.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier rejects go."""
    labels = queries.table(spark, sf_dir, "labels")
    return quality_knn.keep(docs, quality_knn.fit(docs, labels))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or divergence rules reject go."""
    feats = materialize(quality_rules.features(docs), "rules-features")
    return quality_rules.keep(docs, quality_rules.references(feats))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: the one with the smallest doc_id."""
    return minhash.keep(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    with open(queries.tokenizer_file(queries.TOKENIZER), encoding="utf-8") as f:
        return packing.pack_documents(docs, f.read())


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("minhash_near_dedup", near_duplicates),
          ("best_fit_packing", best_fit_packing)]

#: SQL cannot tokenise or train: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
