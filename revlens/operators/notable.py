"""Notable reviews: top-k lists.

Global top-k is ``orderBy(...).limit(k)`` (planned as a per-partition
top-k plus a merge of k rows per partition).  Per-store top-k is
``row_number() <= k``, which Spark plans with a partial
``WindowGroupLimit`` before the shuffle, so a store holding a third of all
rows still sends only k rows per map task.  Every order ends in
``review_id`` (then ``store``) to make the result a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.common import rank_small
from revlens.schema import TRUNC_NOTABLE


COLUMNS = ["review_id", "store", "rating", "sentiment", "text", "date_raw", "author", "likes"]


def _shown(df: DataFrame) -> DataFrame:
    """The columns a list shows, its text cut: projected before any row is sorted."""
    return df.withColumn("text", F.substring("text", 1, TRUNC_NOTABLE)).select(*COLUMNS)


def _top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rank_small(_shown(df).orderBy(*order).limit(k), order).select("rank", *COLUMNS)


def _critical(e: DataFrame) -> DataFrame:
    return e.filter(F.col("has_text") & F.col("rating").isin(1, 2))


def critical_order() -> list[Column]:
    return [F.desc_nulls_last("likes"), F.asc("review_id"), F.asc("store")]


def notable_critical(e: DataFrame, k: int = 15) -> DataFrame:
    """1-2 star reviews with text, most liked first."""
    return _top(_critical(e), critical_order(), k)


def notable_critical_by_store(e: DataFrame, k: int = 10) -> DataFrame:
    """Same per store, k each."""
    w = Window.partitionBy("store").orderBy(*critical_order())
    return _shown(_critical(e)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("rank", *COLUMNS)


def notable_most_liked(e: DataFrame, k: int = 15) -> DataFrame:
    """All rows, most liked first, NULL likes last."""
    return _top(e, critical_order(), k)


def seeded_order(seed: int = 1) -> list[Column]:
    """Repeatable pseudo-random order: md5 of seed and id, whatever the partitioning."""
    return [F.md5(F.concat(F.lit(str(seed)), F.col("review_id"))), F.asc("review_id"), F.asc("store")]


def notable_best_sample(e: DataFrame, k: int = 15, seed: int = 1) -> DataFrame:
    """A seeded sample of 5-star reviews with text."""
    best = e.filter(F.col("has_text") & (F.col("rating") == 5))
    return _top(best, seeded_order(seed), k)
