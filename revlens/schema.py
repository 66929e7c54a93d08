"""Schemas, dictionaries and constants (data only, no logic).

The dictionaries below are parameters of the operators; callers can pass
their own.  The ones marked FIXED VALUES must stay equal to the behaviour
being reproduced, so they are written out plainly and in their natural order.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# Anchor date used by the fixtures and by every query that needs "today".
# Library functions never call current_date(): results must be repeatable.
DEFAULT_AS_OF = _dt.date(2026, 3, 2)

# --------------------------------------------------------------------------
# FIXED VALUES: category keyword dictionary of the full-history analysis,
# in dictionary order (category order decides the joined label order).
# --------------------------------------------------------------------------
ANALYSIS_CATEGORIES: list[tuple[str, list[str]]] = [
    ("Product Quality", ["quality", "product", "item", "defect", "broken", "material",
                         "durable", "genuine", "fake", "original", "condition", "damaged"]),
    ("Customer Service", ["service", "staff", "employee", "helpful", "rude", "assist",
                          "support", "polite", "attitude", "friendly", "ignored",
                          "customer care", "respond", "behavior", "behaviour"]),
    ("Pricing & Value", ["price", "pricing", "expensive", "cheap", "affordable", "value",
                         "worth", "overpriced", "discount", "offer", "deal", "cost", "money"]),
    ("Delivery", ["delivery", "shipping", "courier", "late", "arrived", "dispatch",
                  "tracking", "fast delivery", "delayed", "on time", "deliver"]),
    ("Store Experience", ["store", "shop", "location", "parking", "clean", "organized",
                          "display", "ambiance", "atmosphere", "interior", "mall",
                          "crowded", "visit", "branch", "outlet"]),
    ("Online / App", ["website", "app", "online", "order", "checkout", "payment",
                      "login", "cart", "interface", "loading", "web", "platform"]),
    ("Promotions / Deals", ["promotion", "sale", "offer", "discount", "coupon", "voucher",
                            "cashback", "deal", "lucky draw", "win", "prize", "raffle"]),
    ("After-Sales", ["return", "refund", "exchange", "warranty", "replace",
                     "complaint", "issue", "resolve", "compensation", "claim"]),
    ("Variety / Stock", ["variety", "selection", "stock", "available", "range",
                         "choice", "collection", "assortment", "limited", "out of stock"]),
]

# FIXED VALUES: the weekly report uses six of those categories, in this order,
# with the same keywords.
WEEKLY_CATEGORY_NAMES: list[str] = [
    "Product Quality", "Customer Service", "Pricing & Value",
    "Store Experience", "After-Sales", "Variety / Stock",
]
WEEKLY_CATEGORIES: list[tuple[str, list[str]]] = [
    (name, dict(ANALYSIS_CATEGORIES)[name]) for name in WEEKLY_CATEGORY_NAMES
]

GENERAL_CATEGORY = "General"

# --------------------------------------------------------------------------
# FIXED VALUES: stop words removed before word counts.
# --------------------------------------------------------------------------
STOPWORDS: list[str] = """
a an the and or but in on at to for of is are was were be been being
have has had do does did will would could should may might shall can
i me my we our you your he she it its they them their this that these
those with from by not no so if as when then there also very just
really good great nice well s t""".split()

# FIXED VALUES: word-count token rule and minimum length.
WORD_PATTERN = "[a-z]{3,}"

# FIXED VALUES: sentiment thresholds (exclusive) and label set.
POSITIVE_THRESHOLD = 0.1
NEGATIVE_THRESHOLD = -0.1
SENTIMENT_LABELS: list[str] = ["Positive", "Negative", "Neutral", "No Text"]
NO_TEXT = "No Text"

STARS_DESC: list[int] = [5, 4, 3, 2, 1]

# Text truncation lengths of the list outputs.
TRUNC_NOTABLE = 500
TRUNC_CRITICAL = 600
TRUNC_PRINTED = 180
TRUNC_REPLY = 250

# Newest-N cap per store of the weekly collection.
SNAPSHOT_CAP = 200

# --------------------------------------------------------------------------
# Test lexicon (ours, invented for tests; polarity in ten-thousandths).
# role: scored | negation | intensifier.  Intensity in ten-thousandths.
# --------------------------------------------------------------------------
TEST_LEXICON: list[tuple[str, int, int, str]] = [
    ("great", 8000, 0, "scored"),
    ("friendly", 3750, 0, "scored"),
    ("terrible", -10000, 0, "scored"),
    ("good", 7000, 0, "scored"),
    ("nice", 6000, 0, "scored"),
    ("fair", 7000, 0, "scored"),
    ("rude", -3000, 0, "scored"),
    ("clean", 3667, 0, "scored"),
    ("late", -3000, 0, "scored"),
    ("slow", -3000, 0, "scored"),
    ("worthless", -8000, 0, "scored"),
    ("best", 10000, 0, "scored"),
    ("lucky", 3333, 0, "scored"),
    ("idiot", -8000, 0, "scored"),
    ("stupid", -8000, 0, "scored"),
    ("not", 0, 0, "negation"),
    ("no", 0, 0, "negation"),
    ("never", 0, 0, "negation"),
    ("very", 0, 13000, "intensifier"),
]

# A general lexicon for customer reviews, ours: words by polarity in ten-thousandths.
_GENERAL_WORDS: dict[int, str] = {
    9000: "excellent outstanding perfect superb wonderful fantastic amazing awesome",
    8000: "great love loved brilliant delighted impressive beautiful",
    7000: "good best fair enjoyed enjoy happy pleased glad recommend recommended reliable",
    6000: "nice satisfied helpful lovely comfortable smooth",
    5000: "friendly polite courteous kind caring professional efficient quick fast prompt easy convenient welcoming patient knowledgeable honest genuine generous",
    4000: "clean fresh tidy organized spacious neat affordable cheap cheaper reasonable worth valuable useful safe fine",
    3000: "decent okay ok satisfactory lucky free responsive attentive thanks thank",
    -9000: "terrible horrible awful worst disgusting appalling dreadful",
    -8000: "worthless scam fraud cheated useless pathetic hate hated idiot stupid",
    -7000: "bad disappointing disappointed disappointment unacceptable unprofessional poor cheating",
    -6000: "rude ignored angry upset frustrated frustrating annoying annoyed dirty filthy broken defective damaged faulty",
    -5000: "wrong fake misleading refuse refused unhelpful careless arrogant dishonest lie lied lying overpriced expensive waste wasted",
    -4000: "missing lost expired delayed delay delays problem problems issue issues complaint complaints fail failed failure crash crashed error",
    -3000: "late slow waiting crowded noisy confusing difficult hard unclear lacking limited unavailable cancelled canceled",
}
GENERAL_LEXICON: list[tuple[str, int, int, str]] = [
    *[(w, p, 0, "scored") for p, words in _GENERAL_WORDS.items() for w in words.split()],
    *[(w, 0, 0, "negation") for w in "not no never don't doesn't didn't isn't wasn't aren't won't can't cannot hardly without".split()],
    *[(w, 0, m, "intensifier") for m, words in ((13000, "very really so extremely highly absolutely totally"), (7000, "quite rather somewhat slightly"))
      for w in words.split()],
]

SENTIMENT_TOKEN_PATTERN = "[a-z']+"

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------
RAW_REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("store", T.StringType()),
    T.StructField("author", T.StringType()),
    # kept as text on read: the coercion to a number is an operator
    T.StructField("rating", T.StringType()),
    T.StructField("date_raw", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("likes", T.StringType()),
    T.StructField("owner_reply", T.StringType()),
    T.StructField("has_text", T.BooleanType()),
])

SNAPSHOT_EXTRA_FIELDS = [
    T.StructField("scraped_on", T.DateType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("sent_score", T.DoubleType()),
    T.StructField("categories", T.StringType()),
]

LEXICON_SCHEMA = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("polarity", T.IntegerType()),
    T.StructField("intensity", T.IntegerType()),
    T.StructField("role", T.StringType()),
])

# The result tables of each report sheet, by the names of their queries.
REPORT_SHEETS: dict[str, list[str]] = {
    "dashboard": ["dataset_totals", "store_kpis", "store_comparison"],
    "all_reviews": ["all_reviews"],
    "ratings": ["rating_distribution", "rating_matrix"],
    "sentiment": ["sentiment_stats", "sentiment_share"],
    "categories": ["category_totals", "category_metrics"],
    "trends": ["yearly_summary", "monthly_detail", "monthly_volume", "monthly_avg_rating"],
    "notable_reviews": ["notable_best_sample", "notable_critical", "notable_most_liked", "notable_critical_by_store"],
    "top_words": ["top_words"],
    "weekly_summary": ["weekly_overall", "weekly_by_store", "weekly_store_bands", "weekly_star_dist", "weekly_topics"],
    "all_new_reviews": ["triage_list"],
    "critical_reviews": ["critical_list", "flagged_reviews", "unanswered", "alerts"],
    "weekly_trends": ["snapshot_trends_wide", "week_over_week", "cumulative_rating"],
}
