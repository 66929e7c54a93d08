"""Review enrichment (P1-P13): defaults, coercion, dates, tags, sentiment.

``build_reviews`` is one narrow projection over the review table: no join,
no shuffle, no Python.  Every later query reads its output.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import categories as cat
from revlens.functions import dates
from revlens.functions.sentiment import Lexicon, with_sentiment
from revlens.functions.text import is_nonblank
from revlens.operators.category_table import with_category_table
from revlens.schema import ANALYSIS_CATEGORIES, DEFAULT_AS_OF

ENRICHED_COLUMNS = [
    "review_id", "store", "author", "rating", "date_raw", "text", "likes", "owner_reply",
    "review_date", "month", "month_year", "year", "has_reply", "has_text",
    "sentiment", "sent_sum", "sent_hits", "sent_score", "score_e4",
    "category_list", "categories",
]


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _col_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if _has(df, name) else F.lit(default)


def coerce_rating(c) -> Column:
    """Rating as a number; an unparseable one (or NaN) is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def apply_defaults(df: DataFrame) -> DataFrame:
    """Missing columns and NULLs get the record defaults."""
    return df.select(
        F.coalesce(_col_or(df, "review_id", ""), F.lit("")).cast("string").alias("review_id"),
        F.coalesce(_col_or(df, "store", ""), F.lit("")).cast("string").alias("store"),
        F.coalesce(_col_or(df, "author", "Anonymous"), F.lit("Anonymous")).cast("string").alias("author"),
        coerce_rating(_col_or(df, "rating", None)).alias("rating"),
        F.coalesce(_col_or(df, "date_raw", ""), F.lit("")).cast("string").alias("date_raw"),
        F.coalesce(_col_or(df, "text", ""), F.lit("")).cast("string").alias("text"),
        F.coalesce(_col_or(df, "likes", 0).cast("string").try_cast("int"), F.lit(0)).alias("likes"),
        F.coalesce(_col_or(df, "owner_reply", ""), F.lit("")).cast("string").alias("owner_reply"),
        *[c for c in df.columns if c not in
          ("review_id", "store", "author", "rating", "date_raw", "text", "likes", "owner_reply", "has_text")],
    )


def build_reviews(reviews: DataFrame, as_of: _dt.date = DEFAULT_AS_OF, categories=ANALYSIS_CATEGORIES,
                  lexicon: Lexicon | DataFrame | None = None, extended_dates: bool = False,
                  whole_word: bool = False, defaults: bool = True, strategy: str | None = None) -> DataFrame:
    """Enriched reviews: one row per input row, columns ``ENRICHED_COLUMNS``.

    ``categories``: a dictionary, or a table (category, keyword, position).
    """
    df = apply_defaults(reviews) if defaults else reviews
    df = dates.with_review_date(df, "date_raw", as_of, extended_dates)
    df = (df.withColumn("month", F.trunc("review_date", "MM"))
            .withColumn("month_year", dates.month_year(F.col("review_date")))
            .withColumn("year", F.substring("month_year", 1, 4))
            .withColumn("has_reply", is_nonblank("owner_reply"))
            .withColumn("has_text", is_nonblank("text"))
            # lower-cased once, read by the tags and the sentiment tokens
            .withColumn("_lt", F.lower("text")))
    if isinstance(categories, DataFrame):  # a table of keywords is joined, a dictionary is part of the plan
        df = with_category_table(df, "text", categories)
    else:
        df = df.withColumn("category_list", cat.category_list(F.col("_lt"), categories, whole_word, lowered=True))
    df = df.withColumn("categories", cat.joined(F.col("category_list")))
    df = with_sentiment(df, "text", lexicon, strategy, lowered_text="_lt").drop("_lt")
    extra = [c for c in df.columns if c not in ENRICHED_COLUMNS]
    return df.select(*ENRICHED_COLUMNS, *extra)


def enrich_if_blank(df: DataFrame, categories=ANALYSIS_CATEGORIES, lexicon: Lexicon | DataFrame | None = None,
                    strategy: str | None = None) -> DataFrame:
    """Fill-if-blank enrichment of stored rows (P12): idempotent.

    Sentiment and score are computed only where ``sentiment`` is blank,
    categories only where ``categories`` is blank; filled rows keep theirs.
    """
    cols = df.columns
    base = df
    if "sentiment" not in cols:
        base = base.withColumn("sentiment", F.lit(""))
    if "sent_score" not in cols:
        base = base.withColumn("sent_score", F.lit(0.0))
    if "categories" not in cols:
        base = base.withColumn("categories", F.lit(""))
    base = base.withColumnRenamed("sentiment", "_old_sent") \
               .withColumnRenamed("sent_score", "_old_score") \
               .withColumnRenamed("categories", "_old_cats")
    need_sent = F.coalesce(F.col("_old_sent"), F.lit("")) == ""
    need_cats = F.coalesce(F.col("_old_cats"), F.lit("")) == ""
    # a filled row's text is NULL to the scorer and the tagger, so it is neither tokenised nor searched
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base.withColumn("_t", F.when(need_sent, text)).withColumn("_c", F.when(need_cats, text))
    computed = with_sentiment(base, "_t", lexicon, strategy)
    if isinstance(categories, DataFrame):
        computed, tags = with_category_table(computed, "_c", categories, "_tags"), F.col("_tags")
    else:
        tags = cat.category_list(F.col("_c"), categories)
    out = (computed
           .withColumn("sentiment", F.when(need_sent, F.col("sentiment")).otherwise(F.col("_old_sent")))
           .withColumn("sent_score", F.when(need_sent, F.col("sent_score")).otherwise(F.col("_old_score")))
           .withColumn("categories", F.when(need_cats, cat.joined(tags)).otherwise(F.col("_old_cats"))))
    return out.drop("_tags", "_old_sent", "_old_score", "_old_cats", "_t", "_c", "sent_sum", "sent_hits", "score_e4")
