"""End-to-end jobs: raw JSON reviews to report tables; weekly runs over three dates."""

import datetime as dt

import pytest

from revlens import jobs
from revlens.functions.sentiment import Lexicon
from revlens.plans.catalog import QUERIES, Inputs
from revlens.session import fresh_path
from revlens.sources import fixtures as fx
from tests.conftest import SF001


def _set(df):
    return sorted(tuple(r) for r in df.collect())


def test_run_analysis_from_json(spark):
    raw = fresh_path(spark, "raw-json")
    fx.load_reviews(spark, SF001).write.json(raw)
    out = fresh_path(spark, "analysis")
    done = jobs.run_analysis(spark, raw, out, dt.date(2026, 3, 2), fmt="jsonl", stores=[f"store_{k}" for k in range(6)],
                             lexicon=Lexicon.default().to_dataframe(spark))
    assert len(done) == 19
    got = spark.read.parquet(done["store_comparison"])
    want = QUERIES["store_comparison"](Inputs(spark, SF001))
    assert _set(got.select(*want.columns)) == _set(want)
    got = spark.read.parquet(done["top_words"])
    want = QUERIES["top_words"](Inputs(spark, SF001))
    assert _set(got.select(*want.columns)) == _set(want)


def test_run_weekly_three_dates(spark):
    snaps = Inputs(spark, SF001).snapshots
    landing = fresh_path(spark, "rows")
    snaps.write.partitionBy("snapshot_date").parquet(landing)
    table, out = fresh_path(spark, "snap-table"), fresh_path(spark, "weekly")
    dates = [dt.date(2026, 2, 16), dt.date(2026, 2, 23), dt.date(2026, 3, 2)]
    results = []
    for d in dates:
        rows_path = f"{landing}/snapshot_date={d.isoformat()}"
        results.append(jobs.run_weekly(spark, rows_path, table, f"{out}/{d}", d, fmt="parquet",
                                       store_dim=fx.store_dimension(spark), lexicon=Lexicon.default()))
    assert results[0] is None  # baseline
    last = results[-1]
    got = spark.read.parquet(last["weekly_overall"])
    want = QUERIES["weekly_overall"](Inputs(spark, SF001))
    assert _set(got.select(*want.columns)) == _set(want)
    got = spark.read.parquet(last["critical_reviews"])
    want = QUERIES["flagged_reviews"](Inputs(spark, SF001))
    assert _set(got.select(*want.columns)) == _set(want)
    for sheet, query in (("weekly_trends", "snapshot_trends_wide"), ("week_over_week", "week_over_week"),
                         ("cumulative_rating", "cumulative_rating"), ("unanswered", "unanswered")):
        want = QUERIES[query](Inputs(spark, SF001))
        got = spark.read.parquet(last[sheet]).select(*want.columns)
        assert sorted(map(str, _rows(got))) == sorted(map(str, _rows(want))), sheet


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_run_collection(spark):
    cards = Inputs(spark, SF001).raw_cards
    done = jobs.run_collection(spark, [cards.filter("ord % 4 < 2"), cards.filter("ord % 4 >= 2")], fresh_path(spark, "collect"))
    want = QUERIES["collection_summary"](Inputs(spark, SF001))
    assert _set(spark.read.parquet(done["collection_summary"]).select(*want.columns)) == _set(want)
    assert spark.read.parquet(done["reviews"]).count() == QUERIES["normalize_cards"](Inputs(spark, SF001)).count()


def test_weekly_rows_keep_their_stored_enrichment(spark, tmp_path):
    import json
    for day, ids in (("a", ["1"]), ("b", ["1", "2", "3"])):
        (tmp_path / f"{day}.json").write_text(json.dumps([
            {"review_id": i, "store": "s", "text": "great", "rating": 4.5, "sentiment": "Negative" if i == "2" else "", "sent_score": -0.9,
             "categories": "Mine" if i == "2" else ""} for i in ids]))
    table = fresh_path(spark, "kept")
    assert jobs.run_weekly(spark, str(tmp_path / "a.json"), table, fresh_path(spark, "o"), dt.date(2026, 1, 1)) is None
    done = jobs.run_weekly(spark, str(tmp_path / "b.json"), table, fresh_path(spark, "o"), dt.date(2026, 1, 8))
    got = {r["review_id"]: (r["sentiment"], r["categories"], r["rating"]) for r in spark.read.parquet(done["all_new_reviews"]).collect()}
    assert got == {"2": ("Negative", "Mine", 4.5), "3": ("Positive", "General", 4.5)}


def test_weekly_baseline_is_scored_with_the_jobs_lexicon(spark, tmp_path):
    import json
    words = [f"{x}word" for x in "abcd"]
    for day, n in (("a", 3), ("b", 4)):
        (tmp_path / f"{day}.json").write_text(json.dumps([
            {"review_id": str(i), "store": "s", "text": words[i], "rating": 4.5} for i in range(n)]))
    own = Lexicon([(words[0], 9000, 0, "scored"), (words[1], 9000, 0, "scored"), (words[2], -9000, 0, "scored"), (words[3], -9000, 0, "scored")])
    for lexicon in (own, own.to_dataframe(spark)):
        table = fresh_path(spark, "lex")
        assert jobs.run_weekly(spark, str(tmp_path / "a.json"), table, fresh_path(spark, "o"), dt.date(2026, 1, 1), lexicon=lexicon) is None
        done = jobs.run_weekly(spark, str(tmp_path / "b.json"), table, fresh_path(spark, "o"), dt.date(2026, 1, 8), lexicon=lexicon)
        wow = spark.read.parquet(done["week_over_week"]).filter("is_all and metric in ('positive', 'negative')")
        got = sorted((str(r["snapshot_date"]), r["metric"], r["value"], r["prev_value"]) for r in wow.collect())
        assert got == [("2026-01-01", "negative", 1, None), ("2026-01-01", "positive", 2, None),
                       ("2026-01-08", "negative", 1, 1), ("2026-01-08", "positive", 0, 2)]


def test_weekly_trends_list_every_snapshot_and_configured_store(spark, tmp_path):
    """New rows 5, 3, 0, 1: the empty week is a row of zeros, and the week after is compared with it."""
    import json
    ids = ["12345", "12345678", "12345678", "123456789"]
    table, done = fresh_path(spark, "t"), None
    dim = spark.createDataFrame([("s",), ("quiet",)], "name string")
    for k, own in enumerate(ids):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"review_id": i, "store": "s", "text": "great", "rating": 4} for i in own]))
        done = jobs.run_weekly(spark, str(tmp_path / f"{k}.json"), table, fresh_path(spark, "o"), dt.date(2026, 1, 5 + 7 * k), store_dim=dim)
    trends = {r["snapshot_date"].day: (r["s_new"], r["quiet_new"]) for r in spark.read.parquet(done["weekly_trends"]).collect()}
    assert trends == {5: (5, 0), 12: (3, 0), 19: (0, 0), 26: (1, 0)}
    wow = spark.read.parquet(done["week_over_week"]).filter("is_all and metric = 'new'")
    assert {r["snapshot_date"].day: (r["value"], r["prev_value"]) for r in wow.collect()} == {5: (5, None), 12: (3, 5), 19: (0, 3), 26: (1, 0)}
    by_store = {r["store"]: r["total"] for r in spark.read.parquet(done["weekly_by_store"]).collect()}
    assert by_store == {"s": 1, "quiet": 0}


def test_collection_skips_a_source_that_cannot_be_read(spark, capsys):
    cards = Inputs(spark, SF001).raw_cards
    path, out = fresh_path(spark, "cards"), fresh_path(spark, "collect")
    cards.write.parquet(path)
    done = jobs.run_collection(spark, [path, "/no/such/source"], out)
    assert "source skipped: /no/such/source" in capsys.readouterr().err
    assert spark.read.parquet(done["reviews"]).count() == QUERIES["normalize_cards"](Inputs(spark, SF001)).count()
    with pytest.raises(ValueError, match="no source"):
        jobs.run_collection(spark, ["/no/such/source"], out)


def test_command_line_with_own_dictionaries(spark, tmp_path, capsys):
    import json
    (tmp_path / "r.json").write_text(json.dumps([{"review_id": "1", "store": "s", "text": "zork zork plugh words", "rating": 5}]))
    (tmp_path / "cats.json").write_text("\n".join(json.dumps(r) for r in [
        {"category": "Magic", "keyword": "plu", "position": 1}, {"category": "Caves", "keyword": "ZORK", "position": 0}]))
    (tmp_path / "stop.txt").write_text("zork\nWORDS")
    out = fresh_path(spark, "cli")
    jobs.main(["analysis", str(tmp_path / "r.json"), out, "--as-of", "2026-03-02", "--stores", "s,closed", "--categories", str(tmp_path / "cats.json"),
               "--stop-words", str(tmp_path / "stop.txt")])
    assert f"{out}/report=top_words" in capsys.readouterr().out
    read = lambda n: spark.read.parquet(f"{out}/report={n}").collect()
    assert {r["word"] for r in read("top_words")} == {"plugh"}
    assert [r["categories"] for r in read("all_reviews")] == ["Caves, Magic"]
    assert {(r["category"], r["s"], r["closed"]) for r in read("category_metrics")} == {("Caves", 1, 0), ("Magic", 1, 0)}
