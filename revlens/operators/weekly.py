"""Weekly snapshot diff and report.

Snapshots are one table with a ``snapshot_date`` column (a partition column
when stored).  The previous snapshot is a scalar (one date) resolved before
planning, so both snapshots are read through literal partition filters.

The new-review diff is a left anti join on the id; the planner broadcasts
the previous id set when its estimated size allows and otherwise uses a
shuffle join (AQE re-plans at run time).  The id set is de-duplicated
first, so a hot id (the blank id of cards without one) becomes one row.
The diff of all dates is one window by id; trends need only its sums, which
weekly runs store and add up.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import categories as cat
from revlens.functions.sentiment import Lexicon
from revlens.functions.text import is_nonblank, text_bar, star_label
from revlens.operators.common import count_if, global_rank, pct, rank_small, stack_rows
from revlens.operators.enrich import enrich_if_blank
from revlens.schema import SNAPSHOT_CAP, STARS_DESC, TRUNC_CRITICAL, TRUNC_NOTABLE, WEEKLY_CATEGORIES
from revlens.sources.io import previous_snapshot_date


# -------------------------------------------------------------------------- snapshots

def snapshot_at(snapshots: DataFrame, d: _dt.date) -> DataFrame:
    return snapshots.filter(F.col("snapshot_date") == F.lit(d))


def _rid(c: str = "review_id") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def diff_new(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Rows of ``current`` whose id is not in ``previous``.

    The key ignores the store; a missing id acts as ''.  An absent or empty
    previous snapshot gives no rows (not all rows).  Rows without an id,
    which may be many, do not meet in the join: they are decided by whether
    the previous snapshot has such a row.
    """
    if previous is None:
        return current.limit(0)
    ids = previous.select(_rid().alias("_prev_id"))
    key = F.when(_rid() != "", _rid()).otherwise(F.concat(F.lit("\0"), F.xxhash64(*current.columns).cast("string")))
    return current.filter(ids.exists()) \
        .filter((_rid() != "") | ~ids.filter("_prev_id = ''").exists()) \
        .withColumn("_id", key).join(ids.filter("_prev_id != ''").distinct(), F.col("_id") == F.col("_prev_id"), "left_anti") \
        .drop("_id")


def new_reviews(snapshots: DataFrame, as_of: _dt.date) -> DataFrame:
    """New rows of the ``as_of`` snapshot against the latest earlier one."""
    prev = previous_snapshot_date(snapshots, as_of)
    current = snapshot_at(snapshots, as_of)
    return diff_new(current, snapshot_at(snapshots, prev) if prev is not None else None)


def enrich_new(new: DataFrame, categories=WEEKLY_CATEGORIES, lexicon: Lexicon | DataFrame | None = None) -> DataFrame:
    """Fill-if-blank enrichment of new rows only, plus the reply flag."""
    e = enrich_if_blank(new, categories, lexicon)
    return e.withColumn("has_reply", is_nonblank("owner_reply")) \
            .withColumn("category_list", cat.split_joined("categories"))


def weekly_new(snapshots: DataFrame, as_of: _dt.date, categories=WEEKLY_CATEGORIES,
               lexicon: Lexicon | DataFrame | None = None) -> DataFrame:
    return enrich_new(new_reviews(snapshots, as_of), categories, lexicon)


#: Ids watched for being frequent, and the share of all rows from which one is handled on its own.
HOT_IDS, HOT_SHARE = 64, 1 / 256


@dataclass(frozen=True)
class Calendar:
    """What the one-pass diff must know beforehand: one entry per snapshot date, and per frequent id the dates that hold it."""
    dates: list[_dt.date]
    hot: dict[str, frozenset[_dt.date]]

    def ordinal(self, c: str = "snapshot_date") -> Column:
        return F.element_at(F.create_map(*[x for i, d in enumerate(self.dates) for x in (F.lit(d), F.lit(i))]), F.col(c))

    def previous(self, c: str = "snapshot_date") -> Column:
        """The date before, NULL for the first."""
        pairs = [x for d, p in zip(self.dates, [None, *self.dates]) for x in (F.lit(d), F.lit(p).cast("date"))]
        return F.element_at(F.create_map(*pairs), F.col(c))


def calendar(snapshots: DataFrame) -> Calendar:
    """Snapshot dates, and the ids that hold more than ``HOT_SHARE`` of all rows (a missing id counts as the blank one).

    One narrow pass over dates and ids with mergeable sketches, nothing
    shuffled by id; a second one, over the rows of the frequent ids only, if
    there are any.  At most ``HOT_IDS`` ids by one row per date come back.
    """
    ids = snapshots.select("snapshot_date", _rid().alias("_id"))
    got = ids.agg(F.sort_array(F.collect_set("snapshot_date")).alias("dates"), F.count(F.lit(1)).alias("n"),
                  F.expr(f"approx_top_k(_id, {HOT_IDS}, {64 * HOT_IDS})").alias("top")).first()
    hot = {r["item"] for r in got["top"] or [] if r["count"] > got["n"] * HOT_SHARE} | {""}
    held: dict[str, set[_dt.date]] = {x: set() for x in hot}
    for r in ids.filter(F.col("_id").isin(sorted(hot))).distinct().collect():
        held[r["_id"]].add(r["snapshot_date"])
    return Calendar(list(got["dates"] or []), {x: frozenset(d) for x, d in held.items()})


def snapshot_new(snapshots: DataFrame, known: Calendar | None = None) -> DataFrame:
    """Per date, rows whose id is not in the immediately preceding snapshot.

    The first date counts every row as new; an id that leaves and returns
    counts again.  One scan and one exchange: rows meet by id, and a row is
    new if none of its id's rows lies one date earlier.  Rows of frequent
    ids, the blank one among them, are dealt by their content instead; the
    calendar tells whether the date before holds their id.
    """
    known = known or calendar(snapshots)
    if not known.dates:
        return snapshots.withColumn("prev_date", F.col("snapshot_date")).limit(0)
    hot = _rid().isin(sorted(known.hot))
    key = F.when(hot, F.concat(F.lit("\0"), F.xxhash64(*snapshots.columns).cast("string"))).otherwise(_rid())
    earlier = Window.partitionBy("_key").orderBy("_ord").rangeBetween(-1, -1)
    rows = snapshots.withColumns({"_key": key, "_ord": known.ordinal(), "prev_date": known.previous()})
    rows = rows.withColumn("_before", F.count(F.lit(1)).over(earlier))
    # frequent ids: (id, date) pairs whose date before holds the id
    again = [f"{d} {i}" for i, held in sorted(known.hot.items()) for p, d in zip(known.dates, known.dates[1:]) if p in held]
    seen = F.concat(F.col("snapshot_date").cast("string"), F.lit(" "), _rid()).isin(again)
    return rows.filter(F.when(hot, ~seen).otherwise(F.col("_before") == 0)).drop("_key", "_ord", "_before")


# -------------------------------------------------------------------------- predicates

def rating_or(default: int) -> Column:
    """``rating or default``: NULL and 0 both act as ``default``."""
    return F.coalesce(F.when(F.col("rating") != 0, F.col("rating")), F.lit(default).cast("double"))


def is_critical() -> Column:
    return rating_or(5) <= 2


def is_unanswered_negative() -> Column:
    """(rating <= 3 with NULL/0 as 5, or Negative) and no reply."""
    return ((rating_or(5) <= 3) | (F.coalesce(F.col("sentiment"), F.lit("")) == "Negative")) & ~F.col("has_reply")


# -------------------------------------------------------------------------- weekly stats

def weekly_overall(new: DataFrame) -> DataFrame:
    """One row of weekly counts; all zero when there is nothing new."""
    n = F.count(F.lit(1))
    r = F.col("rating")
    s = F.col("sentiment")
    return new.agg(
        n.alias("total"),
        count_if(r <= 2).alias("critical"),
        count_if(r == 3).alias("low"),
        count_if(r >= 4).alias("good"),
        count_if(s == "Positive").alias("positive"),
        count_if(s == "Negative").alias("negative"),
        count_if(s == "Neutral").alias("neutral"),
        count_if(s == "No Text").alias("no_text"),
        count_if(F.col("has_reply")).alias("with_reply"),
        count_if(~F.col("has_reply")).alias("without_reply"),
        F.avg("rating").alias("avg_rating"),
    )


def _per_store(new: DataFrame, store_dim: DataFrame, aggs: list[Column], zero: list[str]) -> DataFrame:
    """Configured stores left-joined to a per-store aggregate, zero filled.

    Rows of stores outside the configuration are ignored.  Both sides have
    one row per store.
    """
    agg = new.groupBy("store").agg(*aggs)
    dim = store_dim.select(F.col("name").alias("store"))
    j = dim.join(agg, "store", "left")
    for c in zero:
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")))
    return j


def weekly_by_store(new: DataFrame, store_dim: DataFrame, cap: int = SNAPSHOT_CAP) -> DataFrame:
    """Per configured store: new, critical, mean, positive, negative."""
    out = _per_store(new, store_dim, [
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("rating") <= 2).alias("critical"),
        F.avg("rating").alias("avg_rating"),
        count_if(F.col("sentiment") == "Positive").alias("positive"),
        count_if(F.col("sentiment") == "Negative").alias("negative"),
    ], ["total", "critical", "positive", "negative"])
    # the weekly collection keeps the newest `cap` per store: reaching it may hide rows
    return out.withColumn("at_cap", F.col("total") >= F.lit(cap))


def weekly_store_bands(new: DataFrame, store_dim: DataFrame) -> DataFrame:
    """Per configured store: new, critical, needs attention (3), positive (4-5).

    ``*_ref`` columns reproduce the printed report, where "needs attention"
    is always 0 and "positive" is total minus critical.
    """
    out = _per_store(new, store_dim, [
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("rating") <= 2).alias("critical"),
        count_if(F.col("rating") == 3).alias("needs_attention"),
        count_if(F.col("rating") >= 4).alias("positive_4_5"),
    ], ["total", "critical", "needs_attention", "positive_4_5"])
    return out.withColumn("needs_attention_ref", F.lit(0).cast("long")) \
              .withColumn("positive_ref", F.col("total") - F.col("critical"))


def weekly_star_dist(new: DataFrame) -> DataFrame:
    """Stars 5..1: count and % of all new rows, unrated included."""
    g = new.agg(F.count(F.lit(1)).alias("total"), *[count_if(F.col("rating") == s).alias(f"_c{s}") for s in STARS_DESC])
    long = stack_rows(g, ["total"], [{"stars": F.lit(s), "cnt": F.col(f"_c{s}")} for s in STARS_DESC])
    long = long.withColumn("pct", pct(F.col("cnt"), F.col("total")))
    return long.select("stars", star_label(F.col("stars")).alias("star_label"), "cnt", "pct",
                       text_bar(F.col("pct"), 5).alias("bar"))


def weekly_topics(new: DataFrame) -> DataFrame:
    """Count and % of new reviews per category; sums may exceed 100."""
    # every row has at least one category (General otherwise), so counting the
    # first category of each row counts the rows: no second pass, no join
    c = new.select(F.posexplode_outer("category_list").alias("pos", "category")) \
           .filter(F.col("category").isNotNull()).groupBy("category") \
           .agg(F.count(F.lit(1)).alias("cnt"), count_if(F.col("pos") == 0).alias("_first"))
    # one row per category (bounded by the dictionary): the total window is small
    c = c.withColumn("_total", F.sum("_first").over(Window.partitionBy()))
    c = c.withColumn("pct", pct(F.col("cnt"), F.col("_total"))).drop("_first", "_total")
    return rank_small(c, [F.desc("cnt"), F.asc("category")])


# -------------------------------------------------------------------------- lists

def _list_columns(df: DataFrame, n_text: int) -> DataFrame:
    """The columns a list shows, its text cut: projected before the rows are sorted."""
    return df.select("review_id", "store", "rating", "sentiment", F.substring("text", 1, n_text).alias("text"), "date_raw",
                     "author", "categories", "has_reply")


def triage_order() -> list[Column]:
    return [(F.coalesce(F.col("sentiment"), F.lit("")) != "Negative").asc(),
            rating_or(3).desc(), F.asc("review_id"), F.asc("store")]


def triage_list(new: DataFrame) -> DataFrame:
    """All new reviews: Negative first, then rating desc with NULL/0 as 3 (O1)."""
    return global_rank(_list_columns(new, TRUNC_NOTABLE), triage_order())


def critical_list(new: DataFrame) -> DataFrame:
    """New 1-2 star reviews (NULL and 0 not listed), rating ascending (O2)."""
    order = [F.asc("rating"), F.asc("review_id"), F.asc("store")]
    return global_rank(_list_columns(new.filter(is_critical()), TRUNC_CRITICAL), order)


def unanswered(new: DataFrame) -> DataFrame:
    """Unanswered reviews that are 3 stars or less, or Negative."""
    return new.filter(is_unanswered_negative()).select("review_id", "store", "rating", "sentiment", "has_reply")


def flagged_reviews(new: DataFrame) -> DataFrame:
    """Critical or unanswered-negative, one row per id, rating asc with NULL/0 as 5.

    Of the rows of one id the last in store order counts, whole (of several
    in that store the last by date text, author and text).  A partial limit
    leaves one row per id and task before the shuffle.
    """
    f = _list_columns(new.filter(is_critical() | is_unanswered_negative()), TRUNC_CRITICAL)
    last = Window.partitionBy("review_id").orderBy(F.desc("store"), F.desc("date_raw"), F.desc("author"), F.desc("text"), F.desc("rating"))
    one = f.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return global_rank(one, [rating_or(5).asc(), F.asc("review_id")])


def alerts(new: DataFrame) -> DataFrame:
    """New 1-2 star reviews, flagged when unanswered."""
    a = new.filter(is_critical()).select("review_id", "store", "rating", "has_reply", (~F.col("has_reply")).alias("needs_reply"))
    order = [F.desc("needs_reply"), F.asc("rating"), F.asc("review_id"), F.asc("store")]
    return global_rank(a, order)


# -------------------------------------------------------------------------- trends

def week_sums(new: DataFrame, by: list[str]) -> DataFrame:
    """Partial states of new rows per group: counts and sums that can be added up over stores and dates.

    Needs rating, and sentiment and has_reply where present.
    """
    has = set(new.columns)
    sent = lambda x: count_if(F.col("sentiment") == x) if "sentiment" in has else F.lit(0).cast("long")
    replied = lambda c: count_if(c) if "has_reply" in has else F.lit(0).cast("long")
    r, reply = F.col("rating"), F.col("has_reply") if "has_reply" in has else None
    sums = [F.count(F.lit(1)), count_if(r <= 2), count_if(r == 3), count_if(r >= 4), sent("Positive"), sent("Negative"), sent("Neutral"),
            sent("No Text"), replied(reply), replied(None if reply is None else ~reply), F.coalesce(F.sum(r.cast("double")), F.lit(0.0)), F.count(r)]
    return new.groupBy(*by).agg(*[c.alias(k) for k, c in zip(SUMS, sums)])


#: Columns of the partial states, in the order of ``week_sums``.
SUMS = ["new", "critical", "low", "good", "positive", "negative", "neutral", "no_text", "with_reply", "without_reply", "rsum", "rated"]


def grains_of(sums: DataFrame, stores: list[str], dates: list[_dt.date]) -> DataFrame:
    """Partial states per date and configured store, and per date over all rows (store NULL, is_all), zero filled.

    ``sums``: snapshot_date, store and the columns of ``week_sums``;
    ``dates``: all snapshot dates, so that a week without new rows is a row
    of zeros.
    """
    # every sum counts for its store and for all: one pass, one small aggregate
    key = F.explode(F.array(F.concat(F.lit("="), F.col("store")), F.lit("")))
    got = sums.withColumn("_key", key).groupBy("snapshot_date", "_key").agg(*[F.sum(k).alias(k) for k in SUMS])
    cells = [(d, s, f"={s}", False) for d in dates for s in stores] + [(d, None, "", True) for d in dates]
    grid = sums.sparkSession.createDataFrame(cells, "snapshot_date date, store string, _key string, is_all boolean")
    zero = [F.coalesce(k, F.lit(0)).cast("double" if k == "rsum" else "long").alias(k) for k in SUMS]
    return grid.join(got, ["snapshot_date", "_key"], "left").select("snapshot_date", "store", *zero, "is_all")


def weekly_grains(snapshots: DataFrame, stores: list[str], lexicon: Lexicon | DataFrame | None = None, scored: bool = False) -> DataFrame:
    """Partial states of every snapshot date from the snapshots themselves: diffed in one pass, scored afterwards.

    Where weekly runs have stored their sums, ``grains_of`` over those is
    the cheaper way.
    """
    known = calendar(snapshots)
    narrow = ["snapshot_date", "review_id", "store", "rating"]
    if scored:
        new = snapshot_new(snapshots.select(*narrow, *[c for c in SCORED_FROM if c in snapshots.columns]), known)
        new = enrich_if_blank(new, WEEKLY_CATEGORIES, lexicon).withColumn("has_reply", is_nonblank("owner_reply"))
    else:
        new = snapshot_new(snapshots.select(*narrow), known)
    return grains_of(week_sums(new, ["snapshot_date", "store"]), stores, known.dates)


#: What scoring the new rows needs beside the narrow columns.
SCORED_FROM = ["text", "owner_reply", "sentiment", "sent_score", "categories"]


def _mean() -> Column:
    return F.when(F.col("rated") > 0, F.col("rsum") / F.col("rated"))


def trends_of(grains: DataFrame, min_dates: int = 2) -> DataFrame:
    """Per snapshot date and store: new, critical, mean rating (A20); empty below ``min_dates`` dates."""
    # one row per date and store: the unpartitioned windows are bounded
    g = grains.filter(~F.col("is_all")).withColumn("_dates", F.size(F.collect_set("snapshot_date").over(Window.partitionBy())))
    return g.filter(F.col("_dates") >= min_dates).select("snapshot_date", "store", "new", "critical", _mean().alias("avg_rating"))


def snapshot_trends(snapshots: DataFrame, stores: list[str], min_dates: int = 2) -> DataFrame:
    """Per snapshot date and configured store: new, critical, mean rating.

    Needs at least ``min_dates`` snapshots, otherwise empty.
    """
    return trends_of(weekly_grains(snapshots, stores), min_dates)


def trends_wide(long: DataFrame, stores: list[str]) -> DataFrame:
    return long.groupBy("snapshot_date").pivot("store", stores).agg(
        F.first("new").alias("new"), F.first("critical").alias("critical"), F.first("avg_rating").alias("avg"))


def snapshot_trends_wide(snapshots: DataFrame, stores: list[str]) -> DataFrame:
    """The trend table pivoted wide: new, critical and mean per store."""
    return trends_wide(snapshot_trends(snapshots, stores), stores)


#: Weekly metrics and whether more is better: the four per store, and the seven of the chain-wide cards.
METRIC_POLARITY = {"new": True, "critical": False, "avg_rating": True, "pct_negative": False}
OVERALL_POLARITY = {"new": True, "critical": False, "low": False, "good": True, "positive": True, "negative": False,
                    "without_reply": False}


def wow_of(grains: DataFrame) -> DataFrame:
    """Each weekly metric against the week before, per store and overall (D1), from the weekly sums."""
    g = grains.withColumn("avg_rating", _mean()).withColumn("pct_negative", pct(F.col("negative"), F.col("new")))
    entries = lambda polarity: F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(up).alias("higher_is_better")) for m, up in polarity.items()])
    shown = F.when(F.col("is_all"), entries(OVERALL_POLARITY)).otherwise(entries(METRIC_POLARITY))
    metrics = g.select("snapshot_date", "store", "is_all", F.explode(shown).alias("m")).select("snapshot_date", "store", "is_all", "m.*")
    w = Window.partitionBy("is_all", "store", "metric").orderBy("snapshot_date")
    x = metrics.withColumn("prev_value", F.lag("value").over(w))
    delta = F.col("value") - F.col("prev_value")
    return x.withColumn("delta", delta).withColumn(
        "direction",
        F.when(F.col("delta").isNull(), F.lit(None)).when(F.col("delta") > 0, "up")
         .when(F.col("delta") < 0, "down").otherwise("unchanged"),
    ).withColumn(
        "is_good",
        F.when(F.col("delta").isNull() | (F.col("delta") == 0), F.lit(None).cast("boolean"))
         .otherwise((F.col("delta") > 0) == F.col("higher_is_better")),
    ).select("snapshot_date", "is_all", "store", "metric", "value", "prev_value", "delta", "direction", "is_good")


def week_over_week(snapshots: DataFrame, stores: list[str], lexicon: Lexicon | DataFrame | None = None) -> DataFrame:
    """Each weekly metric against the week before, per store and overall.

    direction is up / down / unchanged; is_good follows the metric's
    polarity (a fall of critical or % negative is good).
    """
    return wow_of(weekly_grains(snapshots, stores, lexicon, scored=True))


def cumulative_of(grains: DataFrame) -> DataFrame:
    """Mean rating of each week's new reviews and the running mean over weeks (D2), from the weekly sums."""
    w = Window.partitionBy("store").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cs, cn = F.sum("rsum").over(w), F.sum("rated").over(w)
    return grains.filter(~F.col("is_all")).select("snapshot_date", "store", _mean().alias("week_avg"),
                                                  F.when(cn > 0, cs / cn).alias("cum_avg"))


def cumulative_rating(snapshots: DataFrame, stores: list[str]) -> DataFrame:
    """Mean rating of each week's new reviews and the running mean over weeks."""
    return cumulative_of(weekly_grains(snapshots, stores))
