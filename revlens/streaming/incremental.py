"""Incremental weekly run.

``run_dates`` is the step for arriving snapshots, in any order of dates:

1. their rows are written as the dates' snapshots; an empty one is refused;
2. every arrived date, and the next stored date after each, is diffed
   against the latest stored date before it, since a new snapshot changes
   what is new in its successor;
3. the new rows (enriched) and their sums by store are written. The sums are
   partial states that can be added up over stores and dates; the baseline
   has sums, too (all of its rows count as new in the trends), scored once;
4. one manifest publishes all of it (``sources.commits``): readers see the
   weeks of committed runs only.

Trends, week over week and cumulative means follow from the sums alone: no
old snapshot is read, diffed or scored again.

``stream_weekly`` drives the same step from Structured Streaming: a file
source over a landing folder of snapshot rows, ``availableNow`` trigger and
``foreachBatch``.  A date may arrive in several batches: each time, the date
is rebuilt from all of its rows that have landed, so the last batch gives
what one batch would have given.  The history lives in tables, so no
streaming state or watermark is needed and a lost executor only re-runs its
tasks; a failed batch is re-run from the checkpointed offsets, and nothing
of its first attempt was published.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.sentiment import Lexicon
from revlens.operators.weekly import SUMS, diff_new, enrich_new, grains_of, snapshot_at, week_sums
from revlens.schema import WEEKLY_CATEGORIES
from revlens.sources import commits
from revlens.sources.commits import Week

TABLES = ("overall", "by_store", "new_reviews", "sums")


class EmptySnapshot(ValueError):
    """A weekly run without rows: the stored snapshot of its date stays as it is."""


def _write(df: DataFrame, path: str) -> str:
    df.write.mode("error").parquet(path)
    return path


def _diff_week(spark: SparkSession, week: Week, previous: Week | None, history_path: str, run: str, categories,
               lexicon: Lexicon | DataFrame | None) -> Week:
    """Diff a stored snapshot against the one before and write its new rows and sums, unpublished."""
    current = spark.read.parquet(week.snapshot)
    place = lambda table: f"{history_path}/{table}/as_of={week.as_of.isoformat()}/run={run}"
    new = enrich_new(diff_new(current, spark.read.parquet(previous.snapshot) if previous else None), categories, lexicon)
    # the new rows are written once; the sums read them back
    path = _write(new, place("new_reviews"))
    counted = spark.read.parquet(path) if previous else enrich_new(current, categories, lexicon)
    sums = _write(week_sums(counted, ["store"]), place("sums"))
    return replace(week, prev_date=previous.as_of if previous else None, new_reviews=path, sums=sums)


def run_dates(spark: SparkSession, arrivals: dict[_dt.date, DataFrame], snapshot_path: str, history_path: str,
              categories=WEEKLY_CATEGORIES, lexicon: Lexicon | DataFrame | None = None) -> dict[_dt.date, Week]:
    """Process the snapshots of several dates in one published step; returns all committed weeks."""
    since, weeks = commits.read(spark, history_path)
    run = uuid.uuid4().hex[:12]
    for d, rows in sorted(arrivals.items()):
        if rows.isEmpty():
            raise EmptySnapshot(f"no rows for {d}")
        path = _write(rows.drop("snapshot_date"), f"{snapshot_path}/snapshot_date={d.isoformat()}/run={run}")
        weeks[d] = Week(d, None, path)
    dates = sorted(weeks)
    before = dict(zip(dates, [None, *dates]))
    stale = {d for d in dates if d in arrivals or before[d] in arrivals}
    for d in sorted(stale):
        weeks[d] = _diff_week(spark, weeks[d], weeks.get(before[d]), history_path, run, categories, lexicon)
    commits.publish(spark, history_path, since, weeks)
    return weeks


def run_week(rows: DataFrame, as_of: _dt.date, snapshot_path: str, history_path: str,
             categories=WEEKLY_CATEGORIES, lexicon: Lexicon | DataFrame | None = None) -> _dt.date | None:
    """Process the snapshot of ``as_of``; returns the previous date (None = baseline)."""
    return run_dates(rows.sparkSession, {as_of: rows}, snapshot_path, history_path, categories, lexicon)[as_of].prev_date


def committed_dates(spark: SparkSession, history_path: str) -> dict[_dt.date, _dt.date | None]:
    """Committed date -> the date it was diffed against (None: the baseline)."""
    return {d: w.prev_date for d, w in commits.read(spark, history_path)[1].items()}


def _read(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """Run folders ``<table>/<column>=<date>/run=...`` as one scan, which filters on the date prune."""
    base = paths[0].rsplit("/", 2)[0]
    rows = spark.read.option("basePath", base).option("mergeSchema", True).parquet(*paths).drop("run")
    return rows.withColumn(column, F.col(column).cast("date"))


def read_snapshots(spark: SparkSession, history_path: str) -> DataFrame:
    """The committed snapshots of all dates, keyed by ``snapshot_date``."""
    return _read(spark, [w.snapshot for w in commits.read(spark, history_path)[1].values()], "snapshot_date")


def read_history(spark: SparkSession, history_path: str, table: str = "overall", as_of: _dt.date | None = None,
                 baseline: bool = False) -> DataFrame:
    """A history table of the committed weeks (or of one), keyed by ``as_of`` and ``prev_date``.

    ``sums``: partial states by store; ``overall`` and ``by_store``: read
    from them; ``new_reviews``: the enriched new rows.  The baseline is left
    out unless asked for: it has sums, but no new rows.  A week without new
    rows has an overall row of zeros.
    """
    if table not in TABLES:
        raise ValueError(f"no history table {table}")
    weeks = [w for d, w in sorted(commits.read(spark, history_path)[1].items()) if as_of in (None, d)]
    if not weeks:
        raise ValueError(f"{history_path}: no committed run" + (f" of {as_of}" if as_of else ""))
    rows = _read(spark, [w.new_reviews if table == "new_reviews" else w.sums for w in weeks], "as_of")
    before = F.create_map(*[F.lit(x).cast("date") for w in weeks for x in (w.as_of, w.prev_date)])  # one entry per weekly run
    rows = rows.select("as_of", F.element_at(before, F.col("as_of")).alias("prev_date"), *[c for c in rows.columns if c != "as_of"])
    if not baseline:
        rows = rows.filter(~F.col("as_of").isin([w.as_of for w in weeks if w.prev_date is None]))
    mean = F.when(F.col("rated") > 0, F.col("rsum") / F.col("rated")).alias("avg_rating")
    if table == "by_store":
        return rows.select("as_of", "prev_date", "store", F.col("new").alias("total"), "critical", mean, "positive", "negative")
    if table != "overall":
        return rows
    dates = [(w.as_of, w.prev_date) for w in weeks if baseline or w.prev_date]
    grid = spark.createDataFrame(dates, "as_of date, prev_date date")  # one row per weekly run
    total = rows.groupBy("as_of").agg(*[F.sum(c).alias(c) for c in SUMS])
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias("total" if c == "new" else c) for c in SUMS if c not in ("rsum", "rated")]
    return grid.join(total, "as_of", "left").select("as_of", "prev_date", *counts, mean)


def committed_grains(spark: SparkSession, history_path: str, stores: list[str]) -> DataFrame:
    """Weekly sums per committed date and configured store, zero filled, for the trend tables."""
    sums = read_history(spark, history_path, "sums", baseline=True).withColumnRenamed("as_of", "snapshot_date").drop("prev_date")
    return grains_of(sums, stores, sorted(committed_dates(spark, history_path)))


def stream_weekly(spark: SparkSession, landing_path: str, schema, snapshot_path: str, history_path: str,
                  checkpoint_path: str, categories=WEEKLY_CATEGORIES, lexicon: Lexicon | DataFrame | None = None):
    """Run the weekly step for every snapshot date arriving in ``landing_path``; returns the finished query."""
    def each_batch(batch: DataFrame, _batch_id: int) -> None:
        # the distinct dates of a micro-batch: one per weekly run, a bounded set
        arrived = sorted(r["snapshot_date"] for r in batch.select("snapshot_date").distinct().collect())
        landed = spark.read.schema(schema).parquet(landing_path)
        if arrived:
            run_dates(spark, {d: snapshot_at(landed, d) for d in arrived}, snapshot_path, history_path, categories, lexicon)

    q = (spark.readStream.schema(schema).parquet(landing_path)
         .writeStream.foreachBatch(each_batch)
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q
