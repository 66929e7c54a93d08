"""Benchmark: the full analysis and the weekly report at one scale factor.

Prints ONE JSON line:
  {"metric": "full_run_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Phases (all timed, all run on Spark):
  phase_enrich  build the enriched review table from documents + labels and
                write it as Parquet under the shared folder (the one heavy
                pass over the text: dates, tags, sentiment);
  phase_weekly_new  diff the latest snapshot against the one before and enrich
                only the new rows, written as Parquet (the weekly step);
  <query>       every registered analysis query over the enriched table,
                every weekly report query over the new rows, the rest from
                the driver tables, each executed in full through the no-op
                sink (no driver collect).

Every query runs twice: the first (cold) pass pays JIT and code-generation
warm-up, the second (warm) pass gives the per-query figures.

``value`` (metric ``full_analysis_sec``) is phase_enrich + the 19 analysis-sheet
queries, warm: the counterpart of the reference's "full analysis" (about 2
phase_weekly_new + the weekly report queries; ``all_queries_sec`` is both
phases + all registered queries of the review engine (warm),
``cold_all_queries_sec`` the same with the cold pass.  Phases and queries
have names of their own; a clash stops the run.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.operators import weekly  # noqa: E402
from revlens.plans.catalog import QUERIES, Inputs  # noqa: E402
from revlens.schema import DEFAULT_AS_OF  # noqa: E402
from revlens.session import clear_scratch, local_session, materialize  # noqa: E402
from revlens.sources import fixtures as fx  # noqa: E402

# Queries that write round-trip copies of whole tables (sink tests) are
# timed like the others; the enriched table is shared by the analysis ones.
ENRICHED_QUERIES = {
    "dataset_totals", "store_kpis", "store_comparison", "all_reviews", "rating_distribution", "rating_matrix",
    "sentiment_stats", "sentiment_share", "category_totals", "category_metrics", "yearly_summary",
    "monthly_detail", "monthly_volume", "monthly_avg_rating", "notable_critical", "notable_critical_by_store",
    "notable_most_liked", "notable_best_sample", "top_words", "build_reviews", "parse_relative_date",
    "categorize", "sentiment_score", "sentiment_label", "star_bar", "write_report",
}
# analysis-sheet result (dashboard, all reviews, ratings, sentiment,
# categories, trends, notable reviews, top words).
ANALYSIS_SHEETS = [
    "dataset_totals", "store_kpis", "store_comparison", "all_reviews", "rating_distribution", "rating_matrix",
    "sentiment_stats", "sentiment_share", "category_totals", "category_metrics", "yearly_summary",
    "monthly_detail", "monthly_volume", "monthly_avg_rating", "notable_critical", "notable_critical_by_store",
    "notable_most_liked", "notable_best_sample", "top_words",
]
# The weekly report: the diff and enrichment of new rows plus its sheets.
WEEKLY_REPORT = [
    "new_reviews", "weekly_overall", "weekly_by_store", "weekly_store_bands", "weekly_star_dist", "weekly_topics",
    "triage_list", "critical_list", "unanswered", "flagged_reviews", "alerts", "snapshot_trends_wide",
]
# Weekly report queries read this week's enriched new rows, materialised once
# (as the incremental weekly step does).
NEW_QUERIES = {
    "new_reviews", "weekly_overall", "weekly_by_store", "weekly_store_bands", "weekly_star_dist", "weekly_topics",
    "triage_list", "critical_list", "unanswered", "flagged_reviews", "alerts",
}


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cpus, "revlens-bench")

    timings: dict[str, float] = {}
    t0 = time.time()
    enriched = materialize(fx.load_enriched(spark, sf_dir), "enriched")
    timings["phase_enrich"] = round(time.time() - t0, 3)
    t0 = time.time()
    new = materialize(weekly.weekly_new(fx.load_snapshots(spark, sf_dir), DEFAULT_AS_OF), "weekly-new")
    timings["phase_weekly_new"] = round(time.time() - t0, 3)

    def inputs(name: str) -> Inputs:
        if name in ENRICHED_QUERIES:
            return Inputs(spark, sf_dir, enriched=enriched)
        if name in NEW_QUERIES:
            return Inputs(spark, sf_dir, new=new)
        return Inputs(spark, sf_dir)

    def one_pass() -> dict[str, float]:
        out = {}
        for name in sorted(QUERIES):
            inp = inputs(name)
            t = time.time()
            _run(QUERIES[name](inp))
            out[name] = round(time.time() - t, 3)
        return out

    # first pass: cold (JIT, code generation and plan caches empty);
    # second pass: warm, the per-query figures reported
    cold = one_pass()
    warm = one_pass()
    if clash := timings.keys() & warm.keys():
        raise ValueError(f"phases and queries share names: {clash}")
    timings.update(warm)

    total = round(sum(timings.values()), 3)
    cold_total = round(timings["phase_enrich"] + timings["phase_weekly_new"] + sum(cold.values()), 3)
    full_analysis = round(timings["phase_enrich"] + sum(timings[q] for q in ANALYSIS_SHEETS), 3)
    weekly_report = round(timings["phase_weekly_new"] + sum(timings[q] for q in WEEKLY_REPORT), 3)
    n_reviews = enriched.count()
    print(json.dumps({
        "metric": "full_analysis_sec",
        "value": full_analysis,
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "weekly_report_sec": weekly_report,
        "all_queries_sec": total,
        "cold_all_queries_sec": cold_total,
        "reviews": n_reviews,
        "cpus": cpus,
    }))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
