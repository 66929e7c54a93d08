"""Keyword and lexicon tables, each distinct text handled once; report tables compared with SQL by their contents."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.functions.categories import category_list
from revlens.functions.sentiment import Lexicon, with_sentiment
from revlens.operators.category_table import filed_keywords, to_table, with_category_table
from revlens.operators.enrich import build_reviews, enrich_if_blank
from revlens.plans.catalog import QUERIES, Inputs
from revlens.plans.oracle import oracle_sql
from revlens.schema import ANALYSIS_CATEGORIES, REPORT_SHEETS
from revlens.sources import io
from tests.compare import _rows, duck_connect
from tests.conftest import SF0001


def texts(n, seed=1):
    rnd = random.Random(seed)
    words = [k for _, kws in ANALYSIS_CATEGORIES for k in kws] + ["xx", "Ünder", "a.b", "of", "STAFF", "\n", "é"]
    own = ["".join(rnd.choice([*words, " ", " ", "q"]) for _ in range(rnd.randrange(9))) for _ in range(n)]
    return own + ["", "  ", None, "staff", "staff", None]


def frame(spark, values):
    return spark.createDataFrame([(i % 3, t) for i, t in enumerate(values)], "n int, body string")


def compare(spark, values, categories):
    df = frame(spark, values)
    want = df.select("n", "body", category_list("body", categories).alias("category_list"))
    got = with_category_table(df, "body", to_table(spark, categories))
    assert sorted(map(str, got.select("n", "body", "category_list").collect())) == sorted(map(str, want.collect()))


def test_keyword_table_equals_the_dictionary(spark):
    compare(spark, texts(300), ANALYSIS_CATEGORIES)


@pytest.mark.parametrize("categories", [
    [("Short", ["a", "ée", "Of"]), ("Any", ["xx", ""])], [("Same", ["staff"]), ("Again", ["staff", "STAFF", "taf"])], [("Dots", [".b", "a.b", "\\", "(?"])]])
def test_short_shared_and_odd_keywords(spark, categories):
    compare(spark, [*texts(40, 2), "a.b", "\\ (?", "Ée"], categories)


def test_empty_keyword_table(spark):
    got = with_category_table(frame(spark, ["staff", None]), "body", to_table(spark, []))
    assert [r["category_list"] for r in got.collect()] == [["General"]] * 2


def test_fifty_thousand_keywords_plan_without_a_literal(spark):
    rnd = random.Random(3)
    keywords = sorted({"".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9))) for _ in range(60_000)})[:50_000]
    categories = [(f"c{k}", keywords[k::500]) for k in range(500)]
    table = to_table(spark, categories).repartition(4)
    values = [" ".join(rnd.choice(keywords) for _ in range(6)) for _ in range(30)] + ["nothing here? no", None]
    df = with_category_table(frame(spark, values), "body", table)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert keywords[25_000] not in plan and len(plan) < 100_000
    got = {r["body"]: r["category_list"] for r in df.collect()}
    for t in values:
        want = [name for name, kws in categories if t and any(k in t for k in kws)] or ["General"]
        assert got[t] == want
    assert filed_keywords(table).agg(F.max(F.size("filed"))).first()[0] < 1000


def test_tables_in_the_enrichment(spark):
    rows = spark.createDataFrame([("1", "s", "great staff", "", 0.0, ""), ("2", "s", "terrible price", "Positive", 0.5, "Mine"), ("", "s", None, "", 0.0, "")],
                                 "review_id string, store string, text string, sentiment string, sent_score double, categories string")
    table = to_table(spark, ANALYSIS_CATEGORIES)
    for fn in (lambda c: enrich_if_blank(rows, c), lambda c: build_reviews(rows.select("review_id", "store", "text"), categories=c)):
        cols = ["review_id", "sentiment", "sent_score", "categories"]
        assert sorted(map(str, fn(table).select(*cols).collect())) == sorted(map(str, fn(ANALYSIS_CATEGORIES).select(*cols).collect()))


def test_copies_of_a_text_are_exploded_once(spark):
    df = frame(spark, ["great great nothing", "not so good"] * 500)
    scored = with_sentiment(df, "body", Lexicon.default().to_dataframe(spark))
    qe = scored._jdf.queryExecution()
    opt = qe.optimizedPlan().toString()
    at = opt.index("Generate explode")
    assert "Aggregate [_h1" in opt[at:], opt  # copies meet below the explosion
    assert {(r["body"], r["sent_hits"]) for r in scored.collect()} == {("great great nothing", 2), ("not so good", 1)}


@pytest.fixture(scope="module")
def report(spark):
    i = Inputs(spark, SF0001)
    counts = QUERIES["write_report"](i).collect()
    return i.report_path, {r["result"]: r["rows"] for r in counts}


@pytest.mark.parametrize("name", sorted(n for names in REPORT_SHEETS.values() for n in names))
def test_report_tables_hold_what_sql_gives(spark, report, name):
    path, counts = report
    got = io.read_report(spark, path, name)
    res = duck_connect(SF0001).execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(cols, res.fetchall())
    assert got.count() == counts[name]


def test_report_reads_the_enriched_reviews_twice_for_all_counted_sheets(spark):
    """Once for the review grains, once for the category grains: the sheets A1-A13 read neither reviews nor documents."""
    i = Inputs(spark, SF0001)
    from revlens.operators import metrics
    from revlens.session import materialize
    shared = Inputs(spark, SF0001, grains=materialize(metrics.review_grains(i.enriched), "g"),
                    category_grains=materialize(metrics.category_grains(i.enriched), "c"))
    for sheet in ("dashboard", "ratings", "sentiment", "categories", "trends"):
        for name in REPORT_SHEETS[sheet]:
            plan = QUERIES[name](shared)._jdf.queryExecution().optimizedPlan().toString()
            assert "documents" not in plan and "text" not in plan, name


def _jobs(spark, work) -> int:
    sc, group = spark.sparkContext, f"g{id(work)}"
    sc.setJobGroup(group, "counted")
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_materialised_table_is_read_without_a_job(spark):
    from revlens.session import materialize
    df = spark.range(10).selectExpr("id", "array(struct(id as a, cast(id as string) as b)) as c")
    got = []
    assert _jobs(spark, lambda: got.append(materialize(df, "m"))) == 1
    assert sorted(got[0].collect()) == sorted(df.collect()) and [f.dataType.simpleString() for f in got[0].schema] == ["bigint", "array<struct<a:bigint,b:string>>"]


def test_small_lexicon_table_moves_no_token_and_no_text(spark):
    df = frame(spark, ["great great nothing", "not so good", "", None] * 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = with_sentiment(df, "body", Lexicon.default().to_dataframe(spark)).select("sent_sum", "sent_hits", "sentiment")
        plan = scored._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == 4 and plan.count("SortMergeJoin") == 1, plan
        node = scored._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "Join":
            node = node.children().head()
        assert "body" not in node.left().output().mkString(" ")
        assert {tuple(r) for r in scored.collect()} >= {(0, 0, "No Text")} and scored.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("most", [0, 20_000])
def test_broadcast_and_shuffled_lexicon_give_the_same(spark, monkeypatch, most):
    from revlens.functions import sentiment
    monkeypatch.setattr(sentiment, "BROADCAST_WORDS", most)
    df = frame(spark, ["very good but not so good", "terrible", "", None, "never really bad"] * 3)
    table = with_sentiment(df, "body", Lexicon.default().to_dataframe(spark))
    inline = with_sentiment(df, "body", Lexicon.default())
    assert sorted(map(str, table.collect())) == sorted(map(str, inline.select(*table.columns).collect()))
