"""Hand-computed golden rows for semantics SQL could share a mistake on (FIXTURES.md section 4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.functions import categories as cat
from revlens.functions import dates
from revlens.functions.sentiment import Lexicon, label_from_parts, with_sentiment
from revlens.schema import GENERAL_LEXICON
from revlens.operators.enrich import build_reviews
from revlens.operators import weekly
from revlens.sources import cards

AS_OF = dt.date(2026, 3, 2)


def _month(spark, raws, as_of=AS_OF, extended=False):
    df = spark.createDataFrame([(r,) for r in raws], "d string")
    out = df.select(dates.month_year(dates.resolve_relative_date(F.col("d"), as_of, extended)).alias("m")).collect()
    return [r["m"] for r in out]


@pytest.mark.parametrize("raw,expected", [
    ("just now", "2026-03"), ("an hour ago", "2026-03"), ("30 minutes ago", "2026-03"),
    ("a few seconds ago", "2026-03"), ("today", "2026-03"),
    ("yesterday", "2026-03"),
    ("a month ago", "2026-02"), ("a week ago", "2026-02"), ("a year ago", "2025-03"), ("a day ago", "2026-03"),
    ("5 days ago", "2026-02"), ("Edited 4 months ago", "2025-11"), ("2 years ago", "2024-03"),
    ("  3 Weeks ago  ", "2026-02"), ("11 months ago", "2025-04"),
    ("2 hours ago", None), ("Edited a month ago", None), ("", None), (None, None), ("sometime", None),
    ("3000 years ago", None),
])
def test_relative_date_rules(spark, raw, expected):
    assert _month(spark, [raw]) == [expected]


def test_relative_date_month_end(spark):
    assert _month(spark, ["a month ago"], dt.date(2026, 3, 31)) == ["2026-02"]
    assert _month(spark, ["a year ago"], dt.date(2024, 2, 29)) == ["2023-02"]


def test_relative_date_extended(spark):
    assert _month(spark, ["2 hours ago", "Edited a month ago", "a month ago"], extended=True) == \
        ["2026-03", "2026-02", "2026-02"]


def _tags(spark, texts, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r["c"] for r in df.select(cat.joined(cat.category_list(F.col("t"), **kw)).alias("c")).collect()]


def test_tags_substring_and_multi_category(spark):
    # "deal" inside a longer word tags both categories that list it
    assert _tags(spark, ["An IDEAL place, great"]) == ["Pricing & Value, Promotions / Deals"]
    assert _tags(spark, ["", None, "   "]) == ["General", "General", "General"]
    # "app" inside "happy": substring semantics
    assert _tags(spark, ["so happy"]) == ["Online / App"]


def test_tags_whole_word(spark):
    assert _tags(spark, ["so happy"], whole_word=True) == ["General"]
    assert _tags(spark, ["the app crashed"], whole_word=True) == ["Online / App"]


def test_split_joined_legacy(spark):
    df = spark.createDataFrame([("A, B",), ("",), (None,), (" C ,  ",)], "c string")
    got = [r["x"] for r in df.select(cat.split_joined("c").alias("x")).collect()]
    assert got == [["A", "B"], ["General"], ["General"], ["C"]]


@pytest.mark.parametrize("s,n,text,label", [
    (2000, 1, "x", "Neutral"),      # score 0.1 exactly
    (-2000, 1, "x", "Neutral"),     # -0.1 exactly
    (2002, 1, "x", "Positive"),     # 0.1001
    (-2002, 1, "x", "Negative"),
    (0, 0, "x", "Neutral"),         # no hits
    (5000, 1, "   ", "No Text"),
    (5000, 1, "", "No Text"),
])
def test_label_thresholds(spark, s, n, text, label):
    df = spark.createDataFrame([(s, n, text)], "s long, n int, t string")
    assert df.select(label_from_parts(F.col("t"), F.col("s"), F.col("n")).alias("l")).first()["l"] == label


def test_sentiment_rules(spark):
    df = spark.createDataFrame([
        ("1", "good"),               # 2*7000 / 1 hit -> 0.7
        ("2", "not good"),           # -7000 -> -0.35
        ("3", "very good"),          # 9100 -> 0.91
        ("4", "very great"),         # 10400 clipped to 10000 -> 1.0
        ("5", "not really good"),    # negation two tokens back
        ("6", "no way, not very clean"),  # very: 3667*1.3 = 4767.1 -> 4767, negated
        ("7", "great and terrible"),  # (16000 - 20000) / 2 hits
        ("8", "nothing here"),
    ], "review_id string, text string")
    got = {r["review_id"]: (r["sent_score"], r["sentiment"]) for r in with_sentiment(df).collect()}
    assert got["1"] == (0.7, "Positive")
    assert got["2"] == (-0.35, "Negative")
    assert got["3"] == (0.91, "Positive")
    assert got["4"] == (1.0, "Positive")
    assert got["5"] == (-0.35, "Negative")
    assert got["6"] == (-4767 / 20000, "Negative")
    assert got["7"] == (-4000 / 40000, "Neutral")
    assert got["8"] == (0.0, "Neutral")


def test_sentiment_join_strategy_equals_inline(spark):
    from revlens.sources.fixtures import load_reviews
    r = load_reviews(spark, "/root/testdata/sf0.01").select("review_id", "text")
    a = with_sentiment(r, strategy="inline").select("review_id", "sent_sum", "sent_hits", "sentiment")
    b = with_sentiment(r, strategy="join").select("review_id", "sent_sum", "sent_hits", "sentiment")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_strategies_agree_whatever_the_ids_are(spark):
    rows = [("", "great"), ("", "terrible"), (None, "not good"), (None, "good"), ("a", "very nice"), ("a", "very nice"), ("b", None),
            ("c", ""), ("d", "nothing"), ("e", "no very good, never clean")] + [("hot", "good good bad slow")] * 50
    df = spark.createDataFrame(rows, "review_id string, text string")
    inline, joined = with_sentiment(df), with_sentiment(df, lexicon=Lexicon.default().to_dataframe(spark))
    assert sorted(map(tuple, inline.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)
    assert {r["sentiment"] for r in joined.filter("review_id = ''").collect()} == {"Positive", "Negative"}


def test_a_large_lexicon_is_not_part_of_the_plan(spark):
    lexicon = spark.range(50_000).selectExpr("concat('w', id) AS word", "int(id % 2000 - 1000) AS polarity", "0 AS intensity", "'scored' AS role")
    df = spark.createDataFrame([("1", "w3 w"), ("2", "x")], "review_id string, text string")
    out = with_sentiment(df, lexicon=lexicon)
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 40_000
    with pytest.raises(ValueError):
        with_sentiment(df, lexicon=lexicon, strategy="inline")


def test_general_lexicon(spark):
    lex = Lexicon(GENERAL_LEXICON)
    assert len({(w, r) for w, _, _, r in GENERAL_LEXICON}) == len(GENERAL_LEXICON) > 150
    df = spark.createDataFrame([("1", "Very helpful and quick"), ("2", "The worst, never again"), ("3", "It is a shop")], "i string, text string")
    assert [r["sentiment"] for r in with_sentiment(df, lexicon=lex).orderBy("i").collect()] == ["Positive", "Negative", "Neutral"]


def _new(spark, rows):
    df = spark.createDataFrame(rows, "review_id string, store string, rating int, sentiment string, owner_reply string")
    return df.withColumn("has_reply", F.coalesce(F.col("owner_reply").rlike(r"[^\s\p{Z}]"), F.lit(False)))


def test_null_and_zero_rating_not_critical(spark):
    new = _new(spark, [("a", "s", None, "Neutral", ""), ("b", "s", 0, "Neutral", ""), ("c", "s", 2, "Neutral", "")])
    assert [r["review_id"] for r in new.filter(weekly.is_critical()).collect()] == ["c"]
    # rating 0 is critical for the overall band count (rating <= 2) though
    assert weekly.weekly_overall(new.withColumn("text", F.lit(""))).first()["critical"] == 2


def test_null_reply_is_not_replied(spark):
    new = _new(spark, [("a", "s", 3, "Neutral", None), ("b", "s", 3, "Neutral", "  "), ("c", "s", 3, "Neutral", "ok")])
    assert [r["review_id"] for r in new.filter(weekly.is_unanswered_negative()).orderBy("review_id").collect()] == ["a", "b"]


def test_new_reviews_empty_previous_gives_nothing(spark):
    cur = spark.createDataFrame([("1",), ("2",)], "review_id string")
    assert weekly.diff_new(cur, None).count() == 0
    prev = spark.createDataFrame([("1",)], "review_id string")
    assert [r["review_id"] for r in weekly.diff_new(cur, prev).collect()] == ["2"]
    assert weekly.diff_new(cur, prev.limit(0)).count() == 0


def test_new_reviews_missing_id_matches_missing_id(spark):
    cur = spark.createDataFrame([(None,), ("",), ("3",)], "review_id string")
    prev = spark.createDataFrame([("",)], "review_id string")
    assert [r["review_id"] for r in weekly.diff_new(cur, prev).collect()] == ["3"]
    named = spark.createDataFrame([("9",)], "review_id string")
    assert weekly.diff_new(cur, named).count() == 3  # without such a row before, rows without an id are new


def test_snapshot_new_returning_id_counts_again(spark):
    d1, d2, d3 = dt.date(2026, 1, 1), dt.date(2026, 1, 8), dt.date(2026, 1, 15)
    snaps = spark.createDataFrame([(d1, "a"), (d1, "b"), (d2, "b"), (d3, "a"), (d3, "b")],
                                  "snapshot_date date, review_id string")
    got = sorted((r["snapshot_date"], r["review_id"]) for r in weekly.snapshot_new(snaps).collect())
    assert got == [(d1, "a"), (d1, "b"), (d3, "a")]


def test_keep_first_blank_ids(spark):
    df = spark.createDataFrame([("s", 2, "", "second"), ("s", 1, "", "first"), ("t", 5, "", "other store"),
                                ("s", 3, "x", "x")], "store string, ord long, review_id string, text string")
    got = sorted((r["store"], r["review_id"], r["text"]) for r in cards.dedup_keep_first(df).collect())
    assert got == [("s", "", "first"), ("s", "x", "x"), ("t", "", "other store")]


def test_card_parsers(spark):
    df = spark.createDataFrame([
        ("s", 1, "id", [" ", "Ann "], ["Rated 4.5 stars"], ["\t", " hello "], ["", "2 days ago"], "12", " thanks "),
        ("s", 2, "id2", ["", ""], ["no digits"], [" "], [], "1,234", None),
        ("s", 3, "id3", [], [], [], [], "", ""),
    ], "store string, ord long, review_id string, author_cands array<string>, rating_cands array<string>, "
       "text_cands array<string>, date_cands array<string>, likes_raw string, reply_raw string")
    got = {r["review_id"]: r for r in cards.normalize_cards(df).collect()}
    a = got["id"]
    assert (a["author"], a["rating"], a["text"], a["date_raw"], a["likes"], a["owner_reply"], a["has_text"]) == \
        ("Ann", 4, "hello", "2 days ago", 12, "thanks", True)
    b = got["id2"]
    assert (b["author"], b["rating"], b["text"], b["likes"], b["owner_reply"], b["has_text"]) == \
        ("Anonymous", None, "", 0, "", False)
    assert got["id3"]["likes"] == 0


def test_build_reviews_defaults_missing_columns(spark):
    df = spark.createDataFrame([("1", "s", None, None)], "review_id string, store string, text string, rating string")
    r = build_reviews(df).first()
    assert (r["author"], r["likes"], r["owner_reply"], r["text"], r["sentiment"], r["categories"]) == \
        ("Anonymous", 0, "", "", "No Text", "General")
    df2 = spark.createDataFrame([("1", "s", "x", "five"), ("2", "s", "x", "4")], "review_id string, store string, "
                                "text string, rating string")
    assert sorted((r["review_id"], r["rating"]) for r in build_reviews(df2).collect()) == [("1", None), ("2", 4)]
    df3 = spark.createDataFrame([("1", "4.5"), ("2", "NaN"), ("3", " 3 ")], "review_id string, rating string")
    assert [r["rating"] for r in build_reviews(df3).orderBy("review_id").collect()] == [4.5, None, 3.0]


def test_store_names_that_are_no_plain_column_names(spark):
    from revlens.operators import metrics, trends
    stores = ["St. Mary", "total", "a`b"]
    rows = [("1", "St. Mary", 5.0, "just now"), ("2", "total", 1.0, "a year ago"), ("3", "total", 5.0, "just now"), ("4", "other", 5.0, "just now")]
    e = build_reviews(spark.createDataFrame(rows, "review_id string, store string, rating double, date_raw string"))
    five = metrics.rating_matrix(e, stores).filter("stars = 5").first().asDict()
    assert (five["St. Mary"], five["total"], five["a`b"], five["all_stores"]) == (1, 1, 0, 3)
    month = trends.monthly_detail(e, stores).orderBy("month_year").collect()[-1].asDict()
    assert (month["total"], month["St. Mary"], month["store total"], month["a`b"]) == (3, 1, 1, 0)
    assert sum(r["cnt"] for r in trends.monthly_volume(e, stores).collect()) == 3
    assert trends.yearly_summary(e, stores).count() == 2


def test_empty_inputs(spark):
    """Empty input: typed empty results, and the weekly row is all zero (not missing)."""
    from revlens import jobs
    from revlens.sources.fixtures import store_dimension
    empty = spark.createDataFrame([], "review_id string, store string, rating int, date_raw string, text string, "
                                      "likes int, owner_reply string")
    e = build_reviews(empty)
    for name, df in jobs.analysis_sheets(e, ["store_0"]).items():
        df.collect()  # plans and runs
    assert jobs.analysis_sheets(e, ["store_0"])["store_comparison"].count() == 0
    new = weekly.enrich_new(empty.withColumn("snapshot_date", F.lit(AS_OF)))
    row = weekly.weekly_overall(new).collect()
    assert len(row) == 1 and row[0]["total"] == 0 and row[0]["avg_rating"] is None
    assert [r["cnt"] for r in weekly.weekly_star_dist(new).collect()] == [0, 0, 0, 0, 0]
    by_store = weekly.weekly_by_store(new, store_dimension(spark)).collect()
    assert len(by_store) == 6 and all(r["total"] == 0 and r["avg_rating"] is None for r in by_store)
    one_date = empty.withColumn("snapshot_date", F.lit(AS_OF))
    assert weekly.snapshot_trends(one_date, ["store_0"]).count() == 0
