"""Incremental weekly run driven by Structured Streaming (availableNow + foreachBatch)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.plans.catalog import QUERIES, Inputs
from revlens.session import fresh_path
from revlens.streaming.incremental import EmptySnapshot, read_history, run_week, stream_weekly
from tests.conftest import SF001


def _cmp(df):
    return sorted(tuple(r) for r in df.select("as_of", "prev_date", "total", "critical", "negative",
                                               "with_reply").collect())


def test_stream_matches_batch_weekly_run(spark):
    snaps = Inputs(spark, SF001).snapshots
    landing = fresh_path(spark, "landing")
    # the landing folder receives snapshot rows, one file set per date
    snaps.write.partitionBy("snapshot_date").parquet(landing)
    schema = spark.read.parquet(landing).schema
    snap_path, hist_path, ck = fresh_path(spark, "s"), fresh_path(spark, "h"), fresh_path(spark, "ck")
    stream_weekly(spark, landing, schema, snap_path, hist_path, ck)
    streamed = read_history(spark, hist_path)
    batch = QUERIES["weekly_run"](Inputs(spark, SF001))
    assert _cmp(streamed) == _cmp(batch)
    assert [r["as_of"] for r in streamed.orderBy("as_of").collect()] == [dt.date(2026, 2, 23), dt.date(2026, 3, 2)]


def test_a_date_that_arrives_in_parts_loses_nothing(spark):
    """A date in two arrivals, and an earlier date after a later one, give the tables of the batch run."""
    snaps = Inputs(spark, SF001).snapshots
    landing, args = fresh_path(spark, "landing"), [fresh_path(spark, x) for x in ("s", "h", "ck")]
    schema = snaps.schema
    at = lambda d: F.col("snapshot_date") == F.lit(d)
    half = F.crc32("text") % 2 == 0
    dates = [dt.date(2026, 2, 16), dt.date(2026, 2, 23), dt.date(2026, 3, 2)]
    for part in (at(dates[0]), at(dates[2]) & half, at(dates[2]) & ~half, at(dates[1]) & half, at(dates[1]) & ~half):
        snaps.filter(part).write.mode("append").parquet(landing)
        stream_weekly(spark, landing, schema, *args)
    for table, query in (("overall", "weekly_run"), ("new_reviews", "weekly_run_new_rows"), ("by_store", "weekly_run_by_store")):
        want = QUERIES[query](Inputs(spark, SF001))
        got = read_history(spark, args[1], table).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_empty_snapshot_is_refused(spark):
    snaps = Inputs(spark, SF001).snapshots
    day, paths = dt.date(2026, 2, 16), [fresh_path(spark, "s"), fresh_path(spark, "h")]
    rows = snaps.filter(F.col("snapshot_date") == F.lit(day)).drop("snapshot_date")
    run_week(rows, day, *paths)
    with pytest.raises(EmptySnapshot):
        run_week(rows.limit(0), day, *paths)
    assert spark.read.parquet(paths[0]).count() == rows.count()


def test_baseline_run_writes_no_history(spark):
    snaps = Inputs(spark, SF001).snapshots
    snap_path, hist_path = fresh_path(spark, "s"), fresh_path(spark, "h")
    first = snaps.filter(F.col("snapshot_date") == F.lit(dt.date(2026, 2, 16))).drop("snapshot_date")
    assert run_week(first, dt.date(2026, 2, 16), snap_path, hist_path) is None
    # rerunning the same date is still a baseline and idempotent
    assert run_week(first, dt.date(2026, 2, 16), snap_path, hist_path) is None
    second = snaps.filter(F.col("snapshot_date") == F.lit(dt.date(2026, 2, 23))).drop("snapshot_date")
    assert run_week(second, dt.date(2026, 2, 23), snap_path, hist_path) == dt.date(2026, 2, 16)
    assert run_week(second, dt.date(2026, 2, 23), snap_path, hist_path) == dt.date(2026, 2, 16)
    h = read_history(spark, hist_path).collect()
    assert len(h) == 1 and h[0]["total"] == QUERIES["weekly_run"](Inputs(spark, SF001)).filter("as_of = '2026-02-23'").first()["total"]


def test_weekly_run_with_one_snapshot_is_empty_with_history_columns(spark):
    snaps = Inputs(spark, SF001).snapshots
    one = Inputs(spark, SF001, snapshots=snaps.filter(F.col("snapshot_date") == F.lit(dt.date(2026, 2, 16))))
    a = QUERIES["weekly_run"](one)
    b = QUERIES["weekly_run"](Inputs(spark, SF001))
    assert a.count() == 0 and sorted(a.columns) == sorted(b.columns)
