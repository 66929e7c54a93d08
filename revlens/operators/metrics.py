"""Aggregates of the full-history analysis.

Every table adds up a grain table: reviews counted by store, month, rating
and sentiment, or by category and store, rating and sentiment.  Given review
rows, a function counts them by the columns it needs (partial aggregation on
the map side); a report counts them once (``review_grains``,
``category_grains``) and all of its tables follow from that small result.
Dense grids (every star or label for every group, J4) are produced by
stacking the conditional counts of each group into rows: no cross join.  The
ALL row comes from a rollup (grouping sets ``(store), ()``) and is recognised
by ``grouping(store)``, never by a NULL store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.common import (WEIGHT, as_grains, by_key_and_store, count_if, explode_list, mean_rating, n_if, pct, rank_small,
                                      stack_rows, with_store_columns)
from revlens.schema import SENTIMENT_LABELS, STARS_DESC


def review_grains(e: DataFrame) -> DataFrame:
    """Reviews counted by store, month, rating and sentiment, with replies and scores: all that A1-A7 and A10-A13 need."""
    return as_grains(e, ["store", "month", "rating", "sentiment"], replied=True, scored=True)


def category_grains(e: DataFrame) -> DataFrame:
    """Reviews counted by category, store, rating and sentiment, each review in all of its categories: all that A8 and A9 need."""
    if WEIGHT in e.columns:
        return e
    x = explode_list(e.select("category_list", "store", "rating", "sentiment"), "category_list", "category")
    return as_grains(x, ["category", "store", "rating", "sentiment"])


def stores_from_data(e: DataFrame) -> list[str]:
    """Store names present in the data, sorted, for wide per-store columns.

    Column names must be known when the plan is built, so the distinct
    names are collected: a configuration of the business, not a column that
    grows with the review volume.  Pass the configured list where there is
    one.
    """
    return sorted(r["store"] for r in e.select("store").where(F.col("store").isNotNull()).distinct().collect())


def _sent(label: str):
    return F.col("sentiment") == label


def dataset_totals(e: DataFrame) -> DataFrame:
    """Rows, stores, dated rows and the covered years (A1)."""
    g = as_grains(e, ["store", "month"]).withColumn("year", F.date_format("month", "yyyy"))
    return g.agg(
        n_if().alias("total_reviews"),
        F.countDistinct("store").alias("n_stores"),
        n_if(F.col("month").isNotNull()).alias("dated_reviews"),
        F.array_join(F.sort_array(F.collect_set("year")), ",").alias("years"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def _replied():
    return F.coalesce(F.sum("replied"), F.lit(0).cast("long"))


def store_kpis(e: DataFrame) -> DataFrame:
    """KPI card per store (A2)."""
    return as_grains(e, ["store", "rating", "sentiment"], replied=True).groupBy("store").agg(
        n_if().alias("total"),
        mean_rating().alias("avg_rating"),
        n_if(F.col("rating") == 5).alias("five_star"),
        pct(n_if(_sent("Positive")), n_if()).alias("pct_positive"),
        pct(n_if(_sent("Negative")), n_if()).alias("pct_negative"),
        pct(_replied(), n_if()).alias("pct_replied"),
    )


def store_comparison(e: DataFrame) -> DataFrame:
    """Store comparison table (A3)."""
    return as_grains(e, ["store", "rating", "sentiment"], replied=True).groupBy("store").agg(
        n_if().alias("total"),
        mean_rating().alias("avg_rating"),
        *[n_if(F.col("rating") == s).alias(f"star_{s}") for s in STARS_DESC],
        pct(n_if(_sent("Positive")), n_if()).alias("pct_positive"),
        pct(n_if(_sent("Negative")), n_if()).alias("pct_negative"),
        pct(n_if(_sent("Neutral")), n_if()).alias("pct_neutral"),
        pct(_replied(), n_if()).alias("pct_replied"),
    )


def rating_distribution(e: DataFrame) -> DataFrame:
    """Stars 5..1 for every store and ALL: count and % of rated rows (A4)."""
    g = as_grains(e, ["store", "rating"]).rollup("store").agg(
        F.grouping("store").alias("_g"),
        n_if(F.col("rating").isNotNull()).alias("rated"),
        *[n_if(F.col("rating") == s).alias(f"_c{s}") for s in STARS_DESC],
    )
    g = g.select((F.col("_g") == 1).alias("is_all"), "store", "rated", *[f"_c{s}" for s in STARS_DESC])
    long = stack_rows(g, ["is_all", "store", "rated"],
                      [{"stars": F.lit(s), "cnt": F.col(f"_c{s}")} for s in STARS_DESC])
    return long.withColumn("pct", pct(F.col("cnt"), F.col("rated"))) \
               .withColumn("store", F.when(F.col("is_all"), F.lit(None)).otherwise(F.col("store")))


def rating_matrix(e: DataFrame, stores: list[str]) -> DataFrame:
    """Numeric series behind the rating chart: stars x configured stores + ALL (A5)."""
    g = as_grains(e, ["store", "rating"]).filter(F.col("rating").isin(STARS_DESC)).withColumn("stars", F.col("rating").cast("int"))
    stars = e.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STARS_DESC))).alias("stars"))
    out = stars.join(by_key_and_store(g, "stars", stores, {"all_stores": n_if()}), "stars", "left")
    return with_store_columns(out.withColumn("all_stores", F.coalesce("all_stores", F.lit(0).cast("long"))), stores)


def sentiment_stats(e: DataFrame) -> DataFrame:
    """Per store and ALL, for all four labels.

    Mean score is computed from integer ten-thousandths so it does not
    depend on summation order.
    """
    aggs = [F.grouping("store").alias("_g"), n_if().alias("rows")]
    for i, lab in enumerate(SENTIMENT_LABELS):
        m = _sent(lab)
        aggs += [
            n_if(m).alias(f"_n{i}"),
            mean_rating(m).alias(f"_ar{i}"),
            F.sum(F.when(m, F.col("score_e4"))).alias(f"_se{i}"),
            F.min(F.when(m, F.col("rating"))).alias(f"_mn{i}"),
            F.max(F.when(m, F.col("rating"))).alias(f"_mx{i}"),
        ]
    g = as_grains(e, ["store", "rating", "sentiment"], scored=True).rollup("store").agg(*aggs).withColumn("is_all", F.col("_g") == 1) \
        .withColumn("store", F.when(F.col("is_all"), F.lit(None)).otherwise(F.col("store")))
    entries = []
    for i, lab in enumerate(SENTIMENT_LABELS):
        entries.append({
            "sentiment": F.lit(lab),
            "cnt": F.col(f"_n{i}"),
            "pct": pct(F.col(f"_n{i}"), F.col("rows")),
            "avg_rating": F.col(f"_ar{i}"),
            "avg_score": F.when(F.col(f"_n{i}") > 0, F.col(f"_se{i}") / (F.col(f"_n{i}") * F.lit(10000.0))),
            "min_rating": F.col(f"_mn{i}"),
            "max_rating": F.col(f"_mx{i}"),
        })
    return stack_rows(g, ["is_all", "store"], entries)


def sentiment_share(e: DataFrame) -> DataFrame:
    """Overall Positive / Negative / Neutral counts; No Text left out."""
    labs = ["Positive", "Negative", "Neutral"]
    g = as_grains(e, ["sentiment"]).agg(*[n_if(_sent(l)).alias(f"_{i}") for i, l in enumerate(labs)])
    return stack_rows(g, [], [{"sentiment": F.lit(l), "cnt": F.col(f"_{i}")} for i, l in enumerate(labs)])


def category_totals(e: DataFrame) -> DataFrame:
    """Reviews per category, one review counted in each of its categories."""
    if WEIGHT not in e.columns:
        e = as_grains(explode_list(e.select("category_list"), "category_list", "category"), ["category"])
    c = e.groupBy("category").agg(n_if().alias("cnt"))
    # one row per dictionary entry: bounded, ranking in one task is fine
    return rank_small(c, [F.desc("cnt"), F.asc("category")])


def rating_and_sentiment() -> dict:
    """Sums behind a mean rating and the shares of positive and negative reviews."""
    rated = F.col("rating").isNotNull()
    return {"total": n_if(), "_rsum": F.coalesce(F.sum(F.col("rating") * F.col(WEIGHT)), F.lit(0.0)), "_rated": n_if(rated),
            "_pos": n_if(_sent("Positive")), "_neg": n_if(_sent("Negative"))}


def shown_rating_and_sentiment(*between) -> list:
    return ["total", F.when(F.col("_rated") > 0, F.col("_rsum") / F.col("_rated")).alias("avg_rating"), *between,
            pct(F.col("_pos"), F.col("total")).alias("pct_positive"), pct(F.col("_neg"), F.col("total")).alias("pct_negative")]


def category_metrics(e: DataFrame, stores: list[str]) -> DataFrame:
    """Per category: total, mean rating, % positive / negative, count per store."""
    g = by_key_and_store(category_grains(e), "category", stores, rating_and_sentiment())
    return with_store_columns(g.select("category", *shown_rating_and_sentiment(), "_by_store"), stores)


def collection_summary(cards: DataFrame) -> DataFrame:
    """Rows per store, with text against stars-only."""
    return cards.groupBy("store").agg(
        F.count(F.lit(1)).alias("collected"),
        count_if(F.col("has_text")).alias("with_text"),
        count_if(~F.col("has_text")).alias("stars_only"),
    )


def capture_rate(keys: DataFrame, store_dim: DataFrame, low: float = 85.0, high: float = 95.0) -> DataFrame:
    """Collected / expected per configured store; 85-95 % is normal (D3).

    ``keys``: one row per collected review; only its store is read.  Both
    sides hold one row per store; the planner broadcasts by its own size
    estimate.
    """
    got = keys.groupBy("store").agg(F.count(F.lit(1)).alias("collected"))
    dim = store_dim.select(F.col("name").alias("store"), "expected")
    j = dim.join(got, "store", "left")
    collected = F.coalesce(F.col("collected"), F.lit(0).cast("long"))
    rate = F.when(F.col("expected") > 0, F.lit(100.0) * collected / F.col("expected"))
    return j.select("store", "expected", collected.alias("collected"), rate.alias("capture_pct"),
                    ((rate >= low) & (rate <= high)).alias("in_normal_band"))
