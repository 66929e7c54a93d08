"""Review, snapshot, store and raw-card tables derived from the driver tables.

The given tables are ``documents`` and ``labels``; the review-shaped
tables below are pure DataFrame derivations of them, so their size (and
every query's work) grows with the input.  The rules are those of
FIXTURES.md section 3; the raw-card rule is ours.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources.io import spread

# FIXED VALUES (fixture rules): relative-date phrase by doc_id % 16,
# text prefix by doc_id % 9, owner reply text.
DATE_PHRASES = [
    "just now", "an hour ago", "2 hours ago", "yesterday", "a day ago", "5 days ago",
    "a week ago", "3 weeks ago", "a month ago", "2 months ago", "11 months ago",
    "a year ago", "2 years ago", "Edited 4 months ago", "Edited a month ago", "",
]
TEXT_PREFIXES = [
    "Great service and friendly staff. ", "Terrible delivery, arrived late and damaged. ",
    "Good value, fair price. ", "Not good, refund refused and rude staff. ",
    "Very nice store, clean mall. ", "Out of stock again. ", "Won a lucky draw voucher! ",
    "Website checkout is slow. ", "",
]
REPLY_TEXT = "Thank you for your feedback"
LONG_REPLY = " ".join([REPLY_TEXT] * 12)  # longer than a printed reply

# Snapshot dates and the review_id % 5 classes each one holds.
SNAPSHOT_PLAN = [
    (_dt.date(2026, 2, 16), [0, 1, 2]),
    (_dt.date(2026, 2, 23), [1, 2, 3]),
    (_dt.date(2026, 3, 2), [0, 2, 3, 4]),
]

N_STORES = 5
OTHER_STORE = "store_x"  # not in the configuration
FILLED_CATEGORY = "Kept"  # stored by an earlier run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _rating(i: F.Column) -> F.Column:
    return (
        F.when(i % 23 == 0, F.lit(None))
        .when(i % 41 == 0, F.lit(0))
        .when(i % 43 == 0, F.lit(4.5))
        .when(F.col("toxic") == 1, 1 + i % 2)
        .when(F.col("quality") == 0, 2 + i % 2)
        .when(i % 10 < 6, F.lit(5))
        .when(i % 10 == 6, F.lit(4))
        .when(i % 10 == 7, F.lit(3))
        .when(i % 10 == 8, F.lit(2))
        .otherwise(F.lit(1))
        .cast("double")
    )


def review_text_side(documents: DataFrame) -> DataFrame:
    """Every review column that depends on the document alone (no rating), plus ``doc_id``."""
    d = spread(documents.select("doc_id", "text"))
    i = F.col("doc_id")
    text = (
        F.when(i % 13 == 0, F.lit(""))
        .when(i % 29 == 0, F.lit("   "))
        .otherwise(F.concat(_pick(TEXT_PREFIXES, i % 9), F.col("text")))
    )
    reply = F.when(i % 33 == 0, F.lit(LONG_REPLY)).when(i % 3 == 0, F.lit(REPLY_TEXT)).when(i % 31 == 0, F.lit("  ")).otherwise(F.lit(""))
    return d.select(
        i,
        i.cast("string").alias("review_id"),
        # the store does not follow the snapshot class (doc_id % 5)
        F.concat(F.lit("store_"), (F.floor(i / 5) % N_STORES).cast("string")).alias("store"),
        F.concat(F.lit("author_"), (i % 97).cast("string")).alias("author"),
        _pick(DATE_PHRASES, i % 16).alias("date_raw"),
        text.alias("text"),
        F.when(i % 47 != 0, (i * 7919) % 41).cast("int").alias("likes"),
        reply.alias("owner_reply"),
    )


def attach_rating(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join the label lookup on the unique ``doc_id`` and derive ``rating``.

    The planner broadcasts the lookup only when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time),
    otherwise it is a sort-merge join.  Callers attach the rating *after*
    their per-row text work, so with a sort-merge join only the columns a
    query needs cross the shuffle, not the text.

    The lookup is one row per ``doc_id`` (an aggregate, so a duplicated
    label can never multiply reviews).  Because the optimizer then knows
    the key is unique, a query that never reads ``rating`` has the join
    removed altogether (outer-join elimination): no lookup, no shuffle.
    """
    lab = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = df.join(lab, "doc_id", "left")
    return j.withColumn("rating", _rating(F.col("doc_id"))).drop("quality", "toxic")


REVIEW_COLUMNS = ["review_id", "store", "author", "rating", "date_raw", "text", "likes", "owner_reply"]


def reviews_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One review per document (``review_id`` = doc_id as text)."""
    return attach_rating(review_text_side(documents), labels).select(*REVIEW_COLUMNS)


def enriched_from_documents(documents: DataFrame, labels: DataFrame, **enrich_args) -> DataFrame:
    """Enriched reviews, the text work done before the label lookup.

    Dates, tags and sentiment need the document only; the rating needs
    ``labels``.  Enriching first and joining after keeps the text out of
    the join's shuffle for every query that does not select it.  Same rows
    and values as ``build_reviews(reviews_from_documents(...))``.
    """
    from revlens.operators.enrich import ENRICHED_COLUMNS, build_reviews

    e = build_reviews(review_text_side(documents), **enrich_args).drop("rating")
    return attach_rating(e, labels).select(*ENRICHED_COLUMNS)


def load_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_from_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def load_enriched(spark: SparkSession, sf_dir: str, **enrich_args) -> DataFrame:
    return enriched_from_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                                   **enrich_args)


def snapshots_from_reviews(reviews: DataFrame) -> DataFrame:
    """Dated snapshots: each review is copied into the snapshots of its class.

    Expressed as an explode over the (fixed, three-element) list of dates the
    review belongs to, so no join and no shuffle.  Columns follow the stored
    snapshot layout: review fields, ``scraped_on`` and enrichment columns,
    which are blank but for the rows that an earlier run has filled (id %
    53).  Some reviews are also listed by a store outside the configuration
    (id % 59), some have lost their id (id % 61).
    """
    i = F.col("review_id").cast("long")
    cls = i % 5
    stores = F.when(i % 59 == 0, F.array(F.col("store"), F.lit(OTHER_STORE))).otherwise(F.array("store"))
    filled = i % 53 == 0
    reviews = reviews.withColumns({
        "_stores": stores, "sentiment": F.when(filled, "Positive").otherwise(""), "sent_score": F.when(filled, 0.5).otherwise(0.0),
        "categories": F.when(filled, FILLED_CATEGORY).otherwise(""), "_class": cls,
        "review_id": F.when(i % 61 == 0, "").otherwise(F.col("review_id"))})
    cls = F.col("_class")
    dates = F.filter(
        F.array(*[
            F.when(cls.isin(classes), F.lit(d)) for d, classes in SNAPSHOT_PLAN
        ]),
        lambda x: x.isNotNull(),
    )
    copies = F.flatten(F.transform(dates, lambda d: F.transform(F.col("_stores"), lambda s: F.struct(d.alias("d"), s.alias("s")))))
    return reviews.withColumn("_at", F.explode(copies)).select(
        F.col("_at.d").alias("snapshot_date"), "review_id", F.col("_at.s").alias("store"), "author", "rating", "date_raw", "text",
        "likes", "owner_reply",
        F.col("_at.d").alias("scraped_on"),
        "sentiment", "sent_score", "categories",
    )


def load_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_from_reviews(load_reviews(spark, sf_dir))


def store_dimension(spark: SparkSession) -> DataFrame:
    """Configured stores: five with reviews plus one without (zero fill)."""
    rows = [(f"store_{k}", 50 + 60 * k) for k in range(N_STORES + 1)]
    return spark.createDataFrame(rows, "name string, expected int")


def store_names() -> list[str]:
    return [f"store_{k}" for k in range(N_STORES + 1)]


def raw_cards_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Captured review cards with candidate values (input of the normaliser).

    One card per document plus a repeated card for every 7th document (same
    store and id, later position), blank ids for every 37th and an id that
    several stores share for every 101st, so that keep-first de-duplication
    and the cross-store check have work.  Candidate lists hold blank and
    whitespace entries in front of the real value where the rule says so.
    """
    r = reviews_from_documents(documents, labels)
    i = F.col("review_id").cast("long")
    base = r.select(
        i.alias("_doc"),
        "store",
        (i * 2).alias("ord"),
        F.when(i % 37 == 0, F.lit("")).when(i % 101 == 0, F.concat(F.lit("shared_"), (i % 3).cast("string")))
        .otherwise(F.col("review_id")).alias("review_id"),
        F.when(i % 11 == 0, F.array(F.lit(" "), F.lit("")))
        .otherwise(F.array(F.lit("  "), F.col("author"))).alias("author_cands"),
        F.when(F.col("rating").isNull(), F.array(F.lit("no digits")))
        .otherwise(F.array(F.lit(""), F.concat(F.lit("Rated "), F.floor("rating").cast("string"), F.lit(".5 stars"))))
        .alias("rating_cands"),
        F.array(F.lit("\t"), F.col("text")).alias("text_cands"),
        F.array(F.col("date_raw"), F.lit("ignored later")).alias("date_cands"),
        F.when(i % 19 == 0, F.format_string("%d,%03d", F.col("likes"), F.col("likes")))
        .otherwise(F.col("likes").cast("string")).alias("likes_raw"),
        F.col("owner_reply").alias("reply_raw"),
    )
    repeat = base.filter(F.col("_doc") % 7 == 0).withColumn("ord", F.col("ord") + 1) \
        .withColumn("text_cands", F.array(F.lit("repeated card")))
    return base.unionByName(repeat).drop("_doc")


def load_raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_cards_from_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
