"""The user-facing jobs: collection, full analysis and weekly report.

* ``run_collection``: captured cards of several sources -> review rows (kept
  first per store and id), a summary per store and the cross-store ids.  A
  source that cannot be read is reported and left out.
* ``run_analysis``: raw reviews (JSON or Parquet) -> enriched table (written
  once, Parquet) -> one result table per analysis sheet under
  ``<out>/report=<sheet>/``.
* ``run_weekly``: this week's collected rows -> committed snapshot of the run
  date -> diff against the latest earlier snapshot, enrichment of the new
  rows only -> one result table per weekly sheet.  The first run is a
  baseline: the snapshot and its sums are stored, no report.

Command line:

    python -m revlens.jobs collect <cards>... <out>
    python -m revlens.jobs analysis <reviews> <out> --as-of YYYY-MM-DD [--stop-words <file>] [options]
    python -m revlens.jobs weekly <rows> <snapshots> <out> --as-of YYYY-MM-DD [options]

    options: --format json|jsonl|parquet   --lexicon <table: word, polarity, intensity, role>
             --stores a,b,c | --store-table <table: name, ...>   configured stores, also those without reviews
             --categories <table: category, keyword, position, Parquet or JSON lines>

Session settings (master, memory, ``spark.checkpoint.dir``) come from
``spark-submit``; the jobs set none.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import metrics, notable, trends, weekly, words
from revlens.operators.enrich import build_reviews
from revlens.functions.sentiment import Lexicon
from revlens.schema import ANALYSIS_CATEGORIES, GENERAL_LEXICON, STOPWORDS, WEEKLY_CATEGORIES
from revlens.session import clear_scratch, materialize, scratch_mark
from revlens.sources import cards as cards_mod
from revlens.sources import io
from revlens.streaming.incremental import committed_grains, read_history, run_week


def _read(spark: SparkSession, path: str, fmt: str, stored: bool = False) -> DataFrame:
    if fmt == "json":  # one JSON array per file
        return io.read_reviews_json(spark, path, stored=stored)
    if fmt == "jsonl":  # one JSON object per line
        return io.read_reviews_json(spark, path, multiline=False, stored=stored)
    return io.spread(spark.read.parquet(path))


def analysis_sheets(e: DataFrame, stores: list[str], stopwords: list[str] = STOPWORDS) -> dict[str, DataFrame]:
    """Result tables of the full analysis, keyed by sheet; reviews are counted once, by category once more."""
    flat = e.drop("category_list")
    g = materialize(metrics.review_grains(e), "analysis-grains")
    c = materialize(metrics.category_grains(e), "analysis-category-grains")
    return {
        "dataset_totals": metrics.dataset_totals(g),
        "store_kpis": metrics.store_kpis(g),
        "store_comparison": metrics.store_comparison(g),
        "all_reviews": flat.select("review_id", "store", "author", "rating", "date_raw", "month_year", "sentiment",
                                   "sent_score", "categories", "text", "likes", "has_reply", "owner_reply"),
        "rating_distribution": metrics.rating_distribution(g),
        "rating_matrix": metrics.rating_matrix(g, stores),
        "sentiment_stats": metrics.sentiment_stats(g),
        "sentiment_share": metrics.sentiment_share(g),
        "category_totals": metrics.category_totals(c),
        "category_metrics": metrics.category_metrics(c, stores),
        "yearly_summary": trends.yearly_summary(g, stores),
        "monthly_detail": trends.monthly_detail(g, stores),
        "monthly_volume": trends.monthly_volume(g, stores),
        "monthly_avg_rating": trends.monthly_avg_rating(g),
        "notable_best_sample": notable.notable_best_sample(e),
        "notable_critical": notable.notable_critical(e),
        "notable_most_liked": notable.notable_most_liked(e),
        "notable_critical_by_store": notable.notable_critical_by_store(e),
        "top_words": words.top_words(e, stopwords=stopwords),
    }


def _lexicon(lexicon: Lexicon | DataFrame | None) -> Lexicon | DataFrame:
    return lexicon if lexicon is not None else Lexicon(GENERAL_LEXICON)


def run_analysis(spark: SparkSession, reviews_path: str, out: str, as_of: _dt.date,
                 fmt: str = "json", stores: list[str] | None = None, lexicon: Lexicon | DataFrame | None = None,
                 categories=ANALYSIS_CATEGORIES, stopwords: list[str] = STOPWORDS) -> dict[str, str]:
    """Full analysis of one review set; returns sheet -> written path.

    ``stores``: the configured ones, by default those of the data;
    ``categories``: a dictionary or a table of keywords.

    ``lexicon``: sentiment words, as a ``Lexicon`` or a table (word, polarity,
    intensity, role); by default the general one.
    """
    mark, enriched_path = scratch_mark(), f"{out}/enriched"
    build_reviews(_read(spark, reviews_path, fmt), as_of, categories, _lexicon(lexicon)).write.mode("overwrite").parquet(enriched_path)
    # lineage cut: every sheet reads the written enrichment
    e = spark.read.parquet(enriched_path)
    stores = stores or metrics.stores_from_data(e)
    sheets = analysis_sheets(e, stores, stopwords)
    io.write_report(sheets, out)
    clear_scratch(spark, mark)
    return {name: f"{out}/report={name}" for name in sheets}


def weekly_sheets(new: DataFrame, grains: DataFrame, store_dim: DataFrame, stores: list[str]) -> dict[str, DataFrame]:
    """Result tables of the weekly report, keyed by sheet.

    ``new``: this week's new rows; ``grains``: the stored sums of all weeks
    (``committed_grains``), from which the trends follow without looking at
    old snapshots or new rows again; ``stores``: the names in ``store_dim``.
    """
    return {
        "weekly_overall": weekly.weekly_overall(new),
        "weekly_by_store": weekly.weekly_by_store(new, store_dim),
        "weekly_store_bands": weekly.weekly_store_bands(new, store_dim),
        "weekly_star_dist": weekly.weekly_star_dist(new),
        "weekly_topics": weekly.weekly_topics(new),
        "all_new_reviews": weekly.triage_list(new),
        "critical_list": weekly.critical_list(new),
        "critical_reviews": weekly.flagged_reviews(new),
        "unanswered": weekly.unanswered(new),
        "alerts": weekly.alerts(new),
        "weekly_trends": weekly.trends_wide(weekly.trends_of(grains), stores),
        "week_over_week": weekly.wow_of(grains),
        "cumulative_rating": weekly.cumulative_of(grains),
    }


def run_weekly(spark: SparkSession, rows_path: str, snapshot_path: str, out: str, as_of: _dt.date,
               store_dim: DataFrame | None = None, fmt: str = "json", lexicon: Lexicon | DataFrame | None = None,
               history_path: str | None = None, categories=WEEKLY_CATEGORIES) -> dict[str, str] | None:
    """One weekly run; returns sheet -> written path, or None for a baseline run.

    Stored enrichment of the input rows is kept.  ``history_path`` (by
    default beside the snapshots) holds the new rows and sums of all weeks.
    A run without rows raises ``EmptySnapshot`` and changes nothing.
    """
    mark = scratch_mark()
    history_path = history_path or snapshot_path.rstrip("/") + "-history"
    rows = _read(spark, rows_path, fmt, stored=True)
    if "scraped_on" not in rows.columns:
        rows = rows.withColumn("scraped_on", F.lit(as_of))
    rows = rows.withColumn("scraped_on", F.coalesce("scraped_on", F.lit(as_of)))
    if run_week(rows, as_of, snapshot_path, history_path, categories, _lexicon(lexicon)) is None:
        return None
    new = read_history(spark, history_path, "new_reviews", as_of)
    if store_dim is None:  # the stores that any week has sums of
        names = metrics.stores_from_data(read_history(spark, history_path, "sums", baseline=True))
        store_dim = spark.createDataFrame([(n,) for n in names], "name string")
    stores = [r["name"] for r in store_dim.select("name").collect()]  # configured list: bounded
    sheets = weekly_sheets(new, committed_grains(spark, history_path, stores), store_dim, stores)
    io.write_report(sheets, out)
    clear_scratch(spark, mark)
    return {name: f"{out}/report={name}" for name in sheets}


def run_collection(spark: SparkSession, cards: list[DataFrame | str], out: str) -> dict[str, str]:
    """Captured cards of several sources -> review rows: normalise, keep first per store and id, union, write, summarise.

    A source is a table or the path of one.  A path that cannot be read is
    reported and skipped; the run fails only if no source is left.
    """
    sources, failed = [], []
    for c in cards:
        try:
            sources.append(spark.read.parquet(c) if isinstance(c, str) else c)
        except AnalysisException as e:
            failed.append(c)
            print(f"source skipped: {c}: {str(e).splitlines()[0]}", file=sys.stderr)
    if not sources:
        raise ValueError(f"no source could be read: {failed}")
    path = f"{out}/reviews"
    io.write_reviews(cards_mod.normalize_cards(cards_mod.union_sources(sources)), path)
    rows = spark.read.parquet(path)
    io.write_report({"collection_summary": metrics.collection_summary(rows),
                     "cross_store_duplicates": cards_mod.cross_store_duplicates(rows)}, out)
    return {"reviews": path, "collection_summary": f"{out}/report=collection_summary",
            "cross_store_duplicates": f"{out}/report=cross_store_duplicates"}


def _table(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A small configuration table, Parquet or JSON lines."""
    if path is None:
        return None
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _store_dim(spark: SparkSession, names: str | None, table: str | None) -> DataFrame | None:
    if names and table:
        raise SystemExit("--stores and --store-table exclude each other")
    if names:
        return spark.createDataFrame([(n.strip(),) for n in names.split(",") if n.strip()], "name string")
    return _table(spark, table)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="revlens.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    a = sub.add_parser("analysis")
    a.add_argument("reviews")
    a.add_argument("out")
    a.add_argument("--stop-words", help="text file, words parted by white space, instead of the built-in ones")
    w = sub.add_parser("weekly")
    w.add_argument("rows")
    w.add_argument("snapshots")
    w.add_argument("out")
    for p in (a, w):
        p.add_argument("--as-of", type=_dt.date.fromisoformat, required=True)
        p.add_argument("--format", choices=["json", "jsonl", "parquet"], default="json")
        p.add_argument("--lexicon", help="Parquet table: word, polarity, intensity, role")
        p.add_argument("--stores", help="names of the configured stores, parted by commas")
        p.add_argument("--store-table", help="table of the configured stores: name, ...")
        p.add_argument("--categories", help="table of keywords: category, keyword, position")
    c = sub.add_parser("collect")
    c.add_argument("cards", nargs="+", help="Parquet tables of captured cards, one per source")
    c.add_argument("out")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"revlens-{args.job}").getOrCreate()
    if args.job == "collect":
        done = run_collection(spark, args.cards, args.out)
    else:
        given = {"fmt": args.format, "lexicon": _table(spark, args.lexicon)}
        if args.categories:
            given["categories"] = _table(spark, args.categories)
        dim = _store_dim(spark, args.stores, args.store_table)
        if args.job == "analysis":
            if args.stop_words:
                given["stopwords"] = " ".join(r[0] for r in spark.read.text(args.stop_words).collect()).lower().split()  # a dictionary
            names = dim and [r["name"] for r in dim.select("name").collect()]  # configured list: bounded
            done = run_analysis(spark, args.reviews, args.out, args.as_of, stores=names, **given)
        else:
            done = run_weekly(spark, args.rows, args.snapshots, args.out, args.as_of, store_dim=dim, **given)
    print("baseline run: snapshot stored, no report" if done is None else "\n".join(sorted(done.values())))


if __name__ == "__main__":
    main()
