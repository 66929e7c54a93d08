"""Weekly runs published as one: order of arrival, failures, conflicts, empty weeks, sums."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from revlens.operators import weekly
from revlens.session import fresh_path
from revlens.sources import commits
from revlens.streaming import incremental as inc

D = [dt.date(2026, 1, 5) + dt.timedelta(days=7 * k) for k in range(4)]
# new rows by date: 5 (baseline), 3, 0, 1; id "1" leaves and returns, a blank id stays
IDS = [["1", "2", "3", "4", ""], ["1", "2", "3", "5", "6", "7", ""], ["2", "3", "5", ""], ["2", "3", "5", "1", ""]]


def rows_of(spark, ids):
    return spark.createDataFrame([(i, "a" if i < "4" else "b", "great" if i in ("1", "5") else "terrible", float(len(i) + 3), "") for i in ids],
                                 "review_id string, store string, text string, rating double, owner_reply string")


@pytest.fixture()
def paths(spark):
    return fresh_path(spark, "s"), fresh_path(spark, "h")


@pytest.fixture(scope="module")
def history(spark):
    """The history of all four dates, from one step."""
    snap, hist = fresh_path(spark, "s"), fresh_path(spark, "h")
    inc.run_dates(spark, {D[k]: rows_of(spark, IDS[k]) for k in range(4)}, snap, hist)
    return hist


def state(spark, history):
    """Everything a reader can see, as comparable rows."""
    out = {}
    for table in inc.TABLES:
        df = inc.read_history(spark, history, table, baseline=True)
        out[table] = sorted((str(r) for r in df.select(sorted(df.columns)).collect()))
    out["snapshots"] = sorted(str(r) for r in inc.read_snapshots(spark, history).select("snapshot_date", "review_id", "text").collect())
    return out


def test_every_order_of_arrival_gives_the_same_tables(spark, history, paths):
    for k in (1, 3, 0, 2):
        inc.run_week(rows_of(spark, IDS[k]), D[k], *paths)
    assert state(spark, paths[1]) == state(spark, history)
    assert inc.committed_dates(spark, paths[1]) == inc.committed_dates(spark, history) == dict(zip(D, [None, *D]))


def test_empty_week_is_a_row_of_zeros(spark, history):
    overall = {r["as_of"]: r for r in inc.read_history(spark, history).collect()}
    assert {d: r["total"] for d, r in overall.items()} == {D[1]: 3, D[2]: 0, D[3]: 1}
    assert overall[D[2]]["avg_rating"] is None and overall[D[2]]["positive"] == 0
    grains = inc.committed_grains(spark, history, ["a", "b", "none"])
    trend = {(r["snapshot_date"], r["store"]): r["new"] for r in weekly.trends_of(grains).collect()}
    assert trend == {**{(d, s): 0 for d in D for s in ("a", "b", "none")}, (D[0], "a"): 4, (D[0], "b"): 1, (D[1], "b"): 3, (D[3], "a"): 1}
    wow = {(r["snapshot_date"], r["metric"]): (r["value"], r["prev_value"]) for r in weekly.wow_of(grains).filter("is_all").collect()}
    assert [wow[d, "new"] for d in D] == [(5, None), (3, 5), (0, 3), (1, 0)]
    assert wow[D[1], "positive"] == (1, 1)


def test_trends_read_the_stored_sums_only(spark, history):
    plan = weekly.wow_of(inc.committed_grains(spark, history, ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "review_id" not in plan and " text#" not in plan and ",text#" not in plan


def test_stored_sums_equal_those_of_the_snapshots(spark, history):
    snaps = rows_of(spark, IDS[0]).withColumn("snapshot_date", F.lit(D[0]))
    for k in range(1, 4):
        snaps = snaps.unionByName(rows_of(spark, IDS[k]).withColumn("snapshot_date", F.lit(D[k])))
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(inc.committed_grains(spark, history, ["a", "b"])) == flat(weekly.weekly_grains(snaps, ["a", "b"], scored=True))


@pytest.mark.parametrize("broken", ["new_reviews", "sums", "commit"])
def test_a_run_that_fails_between_two_writes_changes_nothing(spark, paths, monkeypatch, broken):
    inc.run_dates(spark, {D[k]: rows_of(spark, IDS[k]) for k in (0, 1, 3)}, *paths)
    old = state(spark, paths[1])
    with monkeypatch.context() as m:
        if broken == "commit":
            m.setattr(inc.commits, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost driver")))
        else:
            real = inc._write

            def write(df, path):
                if f"/{broken}/as_of={D[3].isoformat()}" in path:  # the successor: its predecessor's tables are written by then
                    raise OSError("lost driver")
                return real(df, path)
            m.setattr(inc, "_write", write)
        with pytest.raises(OSError):
            inc.run_week(rows_of(spark, IDS[2]), D[2], *paths)
    assert state(spark, paths[1]) == old
    inc.run_week(rows_of(spark, IDS[2]), D[2], *paths)  # run again: published whole
    assert {r["as_of"]: r["total"] for r in inc.read_history(spark, paths[1]).collect()} == {D[1]: 3, D[2]: 0, D[3]: 1}
    # what the failed run and the superseded ones have left can be removed
    new = state(spark, paths[1])
    assert commits.remove_superseded(spark, list(paths), paths[1])
    assert state(spark, paths[1]) == new and commits.remove_superseded(spark, list(paths), paths[1]) == []


def test_rerun_of_a_date_replaces_it_and_its_successor(spark, paths):
    inc.run_dates(spark, {D[k]: rows_of(spark, IDS[k]) for k in range(2)}, *paths)
    inc.run_week(rows_of(spark, ["1", "5"]), D[0], *paths)
    new = inc.read_history(spark, paths[1], "new_reviews", D[1])
    assert sorted(r["review_id"] for r in new.collect()) == ["", "2", "3", "6", "7"]
    assert {r["prev_date"] for r in new.collect()} == {D[0]}


def test_a_conflicting_run_is_refused(spark, paths):
    inc.run_week(rows_of(spark, IDS[0]), D[0], *paths)
    since, weeks = commits.read(spark, paths[1])
    commits.publish(spark, paths[1], since, weeks)
    with pytest.raises(commits.ConflictingRun):
        commits.publish(spark, paths[1], since, weeks)
    assert commits.versions(spark, paths[1]) == [1, 2]


def test_history_without_runs(spark, paths):
    with pytest.raises(ValueError, match="no committed run"):
        inc.read_history(spark, paths[1])
    with pytest.raises(ValueError, match="no history table"):
        inc.read_history(spark, paths[1], "nothing")


# ---------------------------------------------------------------- diff of all dates

def brute_new(by_date):
    out, before = [], None
    for d, ids in by_date:
        have = {i or "" for i in ids}
        out += [(d, i) for i in ids if before is None or (i or "") not in before]
        before = have
    return sorted(out, key=str)


def test_diff_of_all_dates_with_hot_blank_missing_and_returning_ids(spark):
    ids = [["hot"] * 300 + ["", None, "1", "2", "2"], ["3", "1"], ["hot"] * 200 + ["1", "", "2"], ["hot"] * 250 + [None, "3"]]
    snaps = spark.createDataFrame([(D[k], i, n) for k, own in enumerate(ids) for n, i in enumerate(own)],
                                  "snapshot_date date, review_id string, n int")
    known = weekly.calendar(snaps)
    assert {"", "hot"} <= set(known.hot) and known.dates == D
    got = weekly.snapshot_new(snaps)
    assert sorted(((r["snapshot_date"], r["review_id"]) for r in got.collect()), key=str) == brute_new(list(zip(D, ids)))
    assert all(r["prev_date"] == dict(zip(D, [None, *D]))[r["snapshot_date"]] for r in got.collect())
    # the same with no id taken out, and without rows
    plain = weekly.snapshot_new(snaps, weekly.Calendar(D, {"": frozenset({D[0], D[2], D[3]})}))
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
    empty = weekly.snapshot_new(snaps.limit(0))
    assert empty.collect() == [] and set(empty.columns) == set(got.columns)


def test_diff_against_pairs_of_dates(spark):
    pool = ["1", "2", "3", "", None]
    for combo in itertools.islice(itertools.product([0, 1], repeat=6), 5, 64, 13):
        ids = [[p for p, on in zip(pool, (*combo[:3], 1, 0)) if on], [p for p, on in zip(pool, (*combo[3:], 0, 1)) if on], ["1", "3"]]
        rows = [(D[k], i) for k, own in enumerate(ids) for i in own]
        snaps = spark.createDataFrame(rows, "snapshot_date date, review_id string")
        got = weekly.snapshot_new(snaps).select("snapshot_date", "review_id")
        assert sorted(map(tuple, got.collect()), key=str) == brute_new([(d, i) for d, i in zip(D, ids) if i])
