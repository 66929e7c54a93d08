"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables (``documents``, ``labels``) through the
derivations in ``revlens.sources.fixtures`` and runs over them whole.
``Inputs`` builds each shared input lazily, so a query plans only what it
reads; a caller that has already materialised the enriched table (the
benchmark) can hand it in.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import text as txt
from revlens.functions.sentiment import Lexicon, with_sentiment
from revlens.operators import category_table, metrics, notable, trends, weekly, words
from revlens.operators.enrich import enrich_if_blank
from revlens.schema import (ANALYSIS_CATEGORIES, DEFAULT_AS_OF, REPORT_SHEETS, TRUNC_CRITICAL, TRUNC_NOTABLE, TRUNC_PRINTED, TRUNC_REPLY,
                            WEEKLY_CATEGORIES)
from revlens.session import fresh_path, materialize
from revlens.sources import cards as cards_mod
from revlens.sources import fixtures as fx
from revlens.sources import io
from revlens.streaming.incremental import read_history, run_week


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: _dt.date = DEFAULT_AS_OF,
                 enriched: DataFrame | None = None, snapshots: DataFrame | None = None,
                 new: DataFrame | None = None, grains: DataFrame | None = None, category_grains: DataFrame | None = None,
                 weekly_grains: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        if enriched is not None:
            self.__dict__["enriched"] = enriched
        if snapshots is not None:
            self.__dict__["snapshots"] = snapshots
        if new is not None:
            self.__dict__["new"] = new
        # counted once by a report; a single query counts the reviews by the columns that it needs
        self._grains, self._category_grains, self.shared_weekly_grains = grains, category_grains, weekly_grains

    @property
    def grains(self) -> DataFrame:
        return self.enriched if self._grains is None else self._grains

    @property
    def category_grains(self) -> DataFrame:
        return self.enriched if self._category_grains is None else self._category_grains

    @cached_property
    def reviews(self) -> DataFrame:
        return fx.load_reviews(self.spark, self.sf_dir)

    @cached_property
    def enriched(self) -> DataFrame:
        # text work first, label lookup after: the text stays out of the join
        return fx.load_enriched(self.spark, self.sf_dir, as_of=self.as_of)

    @cached_property
    def snapshots(self) -> DataFrame:
        return fx.snapshots_from_reviews(self.reviews)

    @cached_property
    def store_dim(self) -> DataFrame:
        return fx.store_dimension(self.spark)

    @property
    def stores(self) -> list[str]:
        return fx.store_names()

    @cached_property
    def raw_cards(self) -> DataFrame:
        return fx.load_raw_cards(self.spark, self.sf_dir)

    @cached_property
    def cards(self) -> DataFrame:
        return cards_mod.normalize_cards(self.raw_cards)

    @cached_property
    def new(self) -> DataFrame:
        return weekly.weekly_new(self.snapshots, self.as_of)


REVIEW_COLUMNS = ["review_id", "store", "author", "rating", "date_raw", "text", "likes", "owner_reply"]


def _enriched_flat(e: DataFrame) -> DataFrame:
    return e.drop("category_list")


# ---------------------------------------------------------------- sources and sinks

def q_scan_reviews(i: Inputs) -> DataFrame:
    """Files that hold one JSON array each, of up to 1,000 reviews."""
    path = fresh_path(i.spark, "raw-reviews-json")
    io.write_json_arrays(i.reviews.select(*REVIEW_COLUMNS), path)
    return io.read_reviews_json(i.spark, path).select(*REVIEW_COLUMNS)


def q_write_reviews(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "reviews")
    io.write_reviews(i.reviews, path)
    return i.spark.read.parquet(path).select(*REVIEW_COLUMNS)


def q_all_snapshots(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "snapshots")
    io.write_snapshot(i.snapshots, path)
    return io.read_snapshots(i.spark, path).select("snapshot_date", "review_id", "store", "rating", "date_raw")


def q_json_snapshots(i: Inputs) -> DataFrame:
    """Snapshots as dated JSON files, one array each, the date in the name."""
    path = fresh_path(i.spark, "json-snapshots")
    for d, _ in fx.SNAPSHOT_PLAN:
        rows = weekly.snapshot_at(i.snapshots, d).select("review_id", "store", "rating", "text", "sentiment")
        io.write_json_arrays(rows, f"{path}/reviews_{d.isoformat()}.json")
    schema = "review_id string, store string, rating double, text string, sentiment string"
    return io.read_json_snapshots(i.spark, path, schema).select("snapshot_date", "review_id", "store", "rating", "sentiment")


def q_write_snapshot(i: Inputs) -> DataFrame:
    """Write all dates, then rerun the last date: the table must not change."""
    path = fresh_path(i.spark, "snapshots")
    io.write_snapshot(i.snapshots, path)
    io.write_snapshot(weekly.snapshot_at(i.snapshots, i.as_of), path)
    return io.read_snapshots(i.spark, path).groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("review_id").alias("ids"))


def q_latest_snapshot(i: Inputs) -> DataFrame:
    rows, d = io.latest_snapshot(i.snapshots, i.as_of)
    return rows.select("snapshot_date", "review_id", "store", "rating")


def q_write_report(i: Inputs) -> DataFrame:
    """Write every table of every sheet under report=<name>/ and read back the row counts (SNK3)."""
    path = fresh_path(i.spark, "report")
    # enrich, diff and count once: every sheet reads these materialised tables
    # (lineage cut in the shared folder, so a lost executor re-reads files)
    e = materialize(i.enriched, "report-enriched")
    shared = Inputs(i.spark, i.sf_dir, i.as_of, enriched=e, snapshots=i.snapshots, new=materialize(i.new, "report-new"),
                    grains=materialize(metrics.review_grains(e), "report-grains"),
                    category_grains=materialize(metrics.category_grains(e), "report-category-grains"),
                    weekly_grains=materialize(weekly.weekly_grains(i.snapshots, i.stores, scored=True), "report-weekly-grains"))
    names = [(sheet, name) for sheet, queries in REPORT_SHEETS.items() for name in queries]
    io.write_report({name: QUERIES[name](shared) for _, name in names}, path)
    i.report_path = path
    parts = [io.read_report(i.spark, path, name).agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(sheet).alias("report"), F.lit(name).alias("result"), "rows") for sheet, name in names]
    return cards_mod.union_sources(parts)


def q_normalize_cards(i: Inputs) -> DataFrame:
    return i.cards.select("store", "review_id", "ord", "author", "rating", "date_raw", "text", "likes",
                          "owner_reply", "has_text")


def q_dedup_reviews(i: Inputs) -> DataFrame:
    raw = i.raw_cards.select("store", F.coalesce("review_id", F.lit("")).alias("review_id"), "ord")
    return cards_mod.dedup_keep_first(raw)


def q_newest_per_store(i: Inputs) -> DataFrame:
    return cards_mod.newest_per_store(i.cards).select("store", "rank", "review_id", "ord")


def q_union_sources(i: Inputs) -> DataFrame:
    a = i.reviews.select("review_id", "store", "rating").withColumn("source", F.lit("reviews"))
    b = i.cards.select("review_id", "store", "rating", "ord", "has_text").withColumn("source", F.lit("cards"))
    return cards_mod.union_sources([a, b]).select("source", "review_id", "store", "rating", "ord", "has_text")


def q_cross_store_duplicates(i: Inputs) -> DataFrame:
    raw = i.raw_cards.select("review_id", "store")
    return cards_mod.cross_store_duplicates(raw)


def q_collection_summary(i: Inputs) -> DataFrame:
    return metrics.collection_summary(i.cards)


def q_capture_rate(i: Inputs) -> DataFrame:
    return metrics.capture_rate(cards_mod.kept_keys(i.raw_cards), i.store_dim)


# ---------------------------------------------------------------- projections

def q_build_reviews(i: Inputs) -> DataFrame:
    return _enriched_flat(i.enriched)


def q_all_reviews(i: Inputs) -> DataFrame:
    return i.enriched.select("review_id", "store", "author", "rating", "date_raw", "month_year", "sentiment",
                             "sent_score", "categories", "text", "likes", "has_reply", "owner_reply")


def q_reply_flag(i: Inputs) -> DataFrame:
    return i.reviews.select("review_id", "owner_reply", txt.is_nonblank("owner_reply").alias("has_reply"))


def q_has_text(i: Inputs) -> DataFrame:
    return i.reviews.select("review_id", txt.is_nonblank("text").alias("has_text"))


def q_parse_relative_date(i: Inputs) -> DataFrame:
    return i.enriched.select("review_id", "date_raw", "review_date", "month_year", "year")


def q_categorize(i: Inputs) -> DataFrame:
    return i.enriched.select("review_id", "categories")


def q_categorize_join(i: Inputs) -> DataFrame:
    """The table of keywords joined, with the keywords of the dictionary."""
    table = category_table.to_table(i.spark, ANALYSIS_CATEGORIES)
    tagged = category_table.with_category_table(i.reviews.select("review_id", "text"), "text", table)
    return tagged.select("review_id", F.array_join("category_list", ", ").alias("categories"))


def q_sentiment_score(i: Inputs) -> DataFrame:
    return i.enriched.select("review_id", "sent_sum", "sent_hits", "sent_score", "score_e4")


def q_sentiment_score_join(i: Inputs) -> DataFrame:
    """The join strategy over rows whose ids are blank, missing or repeated."""
    n = F.col("review_id").cast("long")
    rows = i.reviews.withColumn("review_id", F.when(n % 7 == 0, "").when(n % 11 != 0, (n % 50).cast("string")))
    lexicon = Lexicon.default().to_dataframe(i.spark)
    return with_sentiment(rows, lexicon=lexicon).select("review_id", "sent_sum", "sent_hits", "sent_score", "score_e4", "sentiment")


def q_sentiment_label(i: Inputs) -> DataFrame:
    return i.enriched.select("review_id", "sentiment")


def q_enrich(i: Inputs) -> DataFrame:
    """Fill-if-blank enrichment of stored snapshot rows, applied twice (idempotent)."""
    once = enrich_if_blank(i.snapshots, WEEKLY_CATEGORIES)
    twice = enrich_if_blank(once, WEEKLY_CATEGORIES)
    return twice.select("snapshot_date", "review_id", "sentiment", "sent_score", "categories")


def q_truncate_text(i: Inputs) -> DataFrame:
    return i.reviews.select(
        "review_id",
        txt.truncate("text", TRUNC_NOTABLE).alias("text_500"),
        txt.truncate("text", TRUNC_CRITICAL).alias("text_600"),
        txt.truncate("text", TRUNC_PRINTED).alias("text_180"),
        txt.truncate_ellipsis("owner_reply", TRUNC_REPLY).alias("reply_250"),
    )


def q_star_bar(i: Inputs) -> DataFrame:
    d = metrics.rating_distribution(i.grains).filter(F.col("is_all"))
    return d.select("stars", txt.star_label(F.col("stars")).alias("star_label"), "cnt", "pct",
                    txt.text_bar(F.col("pct"), 5).alias("bar"), txt.text_bar(F.col("pct"), 4).alias("bar_print"))


# ---------------------------------------------------------------- analysis

def q_dataset_totals(i): return metrics.dataset_totals(i.grains)
def q_store_kpis(i): return metrics.store_kpis(i.grains)
def q_store_comparison(i): return metrics.store_comparison(i.grains)
def q_rating_distribution(i): return metrics.rating_distribution(i.grains)
def q_rating_matrix(i): return metrics.rating_matrix(i.grains, i.stores)
def q_sentiment_stats(i): return metrics.sentiment_stats(i.grains)
def q_sentiment_share(i): return metrics.sentiment_share(i.grains)
def q_category_totals(i): return metrics.category_totals(i.category_grains)
def q_category_metrics(i): return metrics.category_metrics(i.category_grains, i.stores)
def q_yearly_summary(i): return trends.yearly_summary(i.grains, i.stores)
def q_monthly_detail(i): return trends.monthly_detail(i.grains, i.stores)
def q_monthly_volume(i): return trends.monthly_volume(i.grains, i.stores)
def q_monthly_avg_rating(i): return trends.monthly_avg_rating(i.grains)
def q_notable_critical(i): return notable.notable_critical(i.enriched)
def q_notable_critical_by_store(i): return notable.notable_critical_by_store(i.enriched)
def q_notable_most_liked(i): return notable.notable_most_liked(i.enriched)
def q_notable_best_sample(i): return notable.notable_best_sample(i.enriched)
def q_top_words(i): return words.top_words(i.enriched)


# ---------------------------------------------------------------- weekly

def q_new_reviews(i: Inputs) -> DataFrame:
    return i.new.select("snapshot_date", "review_id", "store", "rating", "sentiment", "categories", "has_reply")


def q_snapshot_new(i: Inputs) -> DataFrame:
    return weekly.snapshot_new(i.snapshots).select("snapshot_date", "prev_date", "review_id", "store", "rating")


def q_weekly_overall(i): return weekly.weekly_overall(i.new)
def q_weekly_by_store(i): return weekly.weekly_by_store(i.new, i.store_dim)
def q_weekly_store_bands(i): return weekly.weekly_store_bands(i.new, i.store_dim)
def q_weekly_star_dist(i): return weekly.weekly_star_dist(i.new)
def q_weekly_topics(i): return weekly.weekly_topics(i.new)
def q_triage_list(i): return weekly.triage_list(i.new)
def q_critical_list(i): return weekly.critical_list(i.new)
def q_unanswered(i): return weekly.unanswered(i.new)
def q_flagged_reviews(i): return weekly.flagged_reviews(i.new)
def q_alerts(i): return weekly.alerts(i.new)
def _weekly_grains(i, scored=False):
    return i.shared_weekly_grains if i.shared_weekly_grains is not None else weekly.weekly_grains(i.snapshots, i.stores, scored=scored)


def q_snapshot_trends(i): return weekly.trends_of(_weekly_grains(i))
def q_snapshot_trends_wide(i): return weekly.trends_wide(weekly.trends_of(_weekly_grains(i)), i.stores)
def q_week_over_week(i): return weekly.wow_of(_weekly_grains(i, scored=True))
def q_cumulative_rating(i): return weekly.cumulative_of(_weekly_grains(i))


def _weekly_runs(i: Inputs) -> str | None:
    """Feed each snapshot date in order through the incremental weekly step; the history's path, None with a baseline only."""
    snap_path = fresh_path(i.spark, "weekly-snapshots")
    hist_path = fresh_path(i.spark, "weekly-history")
    # the arriving snapshots land once, one partition per run date; each run
    # then reads its own partition (partition pruning), as a weekly job would
    landing = fresh_path(i.spark, "weekly-landing")
    io.write_snapshot(i.snapshots, landing)
    arrived = io.read_snapshots(i.spark, landing)
    # one row per weekly run date: a bounded list
    dates = sorted(r["snapshot_date"] for r in arrived.select("snapshot_date").distinct().collect())
    for d in dates:  # (each run publishes before the next one begins)
        run_week(weekly.snapshot_at(arrived, d).drop("snapshot_date"), d, snap_path, hist_path)
    return hist_path if len(dates) > 1 else None


def _run_key() -> list:
    return [F.lit(None).cast("date").alias("as_of"), F.lit(None).cast("date").alias("prev_date")]


def q_weekly_run(i: Inputs) -> DataFrame:
    """The overall row of every weekly run."""
    path = _weekly_runs(i)
    if path is None:  # no history rows, same columns as the history table
        return weekly.weekly_overall(i.new).select(*_run_key(), "*").limit(0)
    return read_history(i.spark, path)


RUN_COLUMNS = ["review_id", "store", "rating", "sentiment", "sent_score", "categories", "has_reply"]


def q_weekly_run_new_rows(i: Inputs) -> DataFrame:
    """The stored new rows of every weekly run."""
    path = _weekly_runs(i)
    if path is None:
        return i.new.select(*_run_key(), *RUN_COLUMNS).limit(0)
    return read_history(i.spark, path, "new_reviews").select("as_of", "prev_date", *RUN_COLUMNS)


def q_weekly_run_by_store(i: Inputs) -> DataFrame:
    """The stored sums by store of every weekly run."""
    columns = ["store", "total", "critical", "avg_rating", "positive", "negative"]
    path = _weekly_runs(i)
    if path is None:
        return weekly.weekly_by_store(i.new, i.store_dim).select(*_run_key(), *columns).limit(0)
    return read_history(i.spark, path, "by_store").select("as_of", "prev_date", *columns)


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def make_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Inputs(spark, sf_dir))

    run.__name__ = name
    return run
