"""Review-card normaliser (SRC4, P14-P16, W1, W2, U1, U3).

Input: captured cards ``(store, ord, review_id, author_cands, rating_cands,
text_cands, date_cands, likes_raw, reply_raw)`` where each ``*_cands``
array holds the candidate values in selector priority.  Output: review
rows.  All per-card work is one projection; the only shuffle is the
keep-first de-duplication, with a partial limit so that a hot id (e.g. the
blank id) is cut down map-side instead of landing whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.text import NONBLANK_RE, is_nonblank, strip
from revlens.schema import SNAPSHOT_CAP


def first_nonblank(cands: str, default: str) -> Column:
    """First candidate that is non-blank after strip, stripped; else default."""
    hit = F.get(F.filter(F.col(cands), lambda x: x.rlike(NONBLANK_RE)), 0)
    return F.coalesce(strip(hit), F.lit(default))


def rating_from_labels(cands: str) -> Column:
    """First digit run of the first label that has one; none gives NULL."""
    lab = F.get(F.filter(F.col(cands), lambda x: x.rlike("[0-9]")), 0)
    return F.regexp_extract(lab, "([0-9]+)", 1).try_cast("int")


def parse_likes(raw: str) -> Column:
    """Integer only when all digits ('1,234' and blank give 0)."""
    c = F.col(raw)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).otherwise(F.lit(0)).cast("int")


def normalize_fields(cards: DataFrame) -> DataFrame:
    """Per-card field choice and parsing, no de-duplication."""
    text = first_nonblank("text_cands", "")
    return cards.select(
        "store", "ord",
        F.coalesce(F.col("review_id"), F.lit("")).alias("review_id"),
        first_nonblank("author_cands", "Anonymous").alias("author"),
        rating_from_labels("rating_cands").alias("rating"),
        first_nonblank("date_cands", "").alias("date_raw"),
        text.alias("text"),
        parse_likes("likes_raw").alias("likes"),
        F.coalesce(strip(F.col("reply_raw")), F.lit("")).alias("owner_reply"),
        is_nonblank(text).alias("has_text"),
    )


def dedup_keep_first(df: DataFrame, keys=("store", "review_id"), order: str = "ord") -> DataFrame:
    """First row per key by ``order`` (W1); blank ids count as one id.

    Of rows with equal order the one with the smallest hash of its columns
    is kept.  ``row_number() = 1`` is planned with a partial group limit: one
    row per key and map task crosses the shuffle, also for a key that holds
    a third of all rows, and rows are ordered by their keys, not by text.
    """
    first = Window.partitionBy(*keys).orderBy(F.asc(order), F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").select(*keys, *[c for c in df.columns if c not in keys])


def normalize_cards(cards: DataFrame) -> DataFrame:
    """Cards to review rows: field choice then keep-first per store and id (SRC4)."""
    return dedup_keep_first(normalize_fields(cards))


def kept_keys(cards: DataFrame) -> DataFrame:
    """(store, review_id) of the cards that ``normalize_cards`` keeps: their distinct keys, no other column read."""
    return cards.select("store", F.coalesce(F.col("review_id"), F.lit("")).alias("review_id")).distinct()


def newest_per_store(reviews: DataFrame, n: int = SNAPSHOT_CAP, order: str = "ord") -> DataFrame:
    """First ``n`` rows per store in newest-first order.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit, so
    each map task sends at most ``n`` rows per store.
    """
    w = Window.partitionBy("store").orderBy(F.asc(order), F.asc("review_id"))
    return reviews.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate per-source review sets, tolerating schema differences."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cross_store_duplicates(df: DataFrame) -> DataFrame:
    """Ids that occur under more than one store (U3): a data check.

    A missing id identifies nothing and is left out.  Distinct (id, store)
    pairs first (partial aggregate), then a count per id; no group is ever
    collected.
    """
    pairs = df.filter(F.coalesce(F.col("review_id"), F.lit("")) != "").select("review_id", "store") \
              .groupBy("review_id", "store").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n_stores"),
        F.sum("_n").cast("long").alias("n_rows"),
        F.min("store").alias("first_store"),
        F.max("store").alias("last_store"),
    ).filter(F.col("n_stores") > 1)
