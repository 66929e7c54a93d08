"""Time trends over dated reviews (A10-A13), added up from a grain table (see ``metrics``).

Only rows with a resolved date take part.  Store columns are the configured
store list (explicit values), so a store without dated rows shows 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.dates import month_label
from revlens.operators.common import as_grains, by_key_and_store, mean_rating, n_if, with_store_columns
from revlens.operators.metrics import rating_and_sentiment, shown_rating_and_sentiment
from revlens.schema import STARS_DESC


def _dated(e: DataFrame, *dims: str) -> DataFrame:
    return as_grains(e, ["month", *dims]).filter(F.col("month").isNotNull())


def yearly_summary(e: DataFrame, stores: list[str]) -> DataFrame:
    """Per year: total, mean rating, % positive / negative, reviews per store (A10)."""
    g = _dated(e, "store", "rating", "sentiment").withColumn("year", F.date_format("month", "yyyy"))
    t = by_key_and_store(g, "year", stores, rating_and_sentiment())
    return with_store_columns(t.select("year", *shown_rating_and_sentiment(), "_by_store"), stores)


def monthly_detail(e: DataFrame, stores: list[str]) -> DataFrame:
    """Per month: label, total, mean, star counts, %, per-store counts.

    Months without reviews are not filled in.
    """
    stars = {f"star_{s}": n_if(F.col("rating") == s) for s in STARS_DESC}
    t = by_key_and_store(_dated(e, "store", "rating", "sentiment"), "month", stores, rating_and_sentiment() | stars)
    t = t.select(
        F.date_format("month", "yyyy-MM").alias("month_year"),
        month_label(F.col("month")).alias("month_label"),
        F.date_format("month", "yyyy").alias("year"),
        *shown_rating_and_sentiment(*stars), "_by_store")
    return with_store_columns(t, stores)


def monthly_volume(e: DataFrame, stores: list[str]) -> DataFrame:
    """Long series: reviews per month and configured store, zero filled.

    One aggregate by month and store; each month then has a row for every
    configured store.
    """
    t = by_key_and_store(_dated(e, "store"), "month", stores, {"total": n_if()})
    return t.select("month", "_by_store", F.explode(F.array(*map(F.lit, stores))).alias("store")).select(
        F.date_format("month", "yyyy-MM").alias("month_year"), "store",
        F.coalesce(F.try_element_at("_by_store", F.col("store")), F.lit(0).cast("long")).alias("cnt"))


def monthly_avg_rating(e: DataFrame) -> DataFrame:
    """Mean rating per month over all stores; NULL when no rated row."""
    return _dated(e, "rating").groupBy("month").agg(mean_rating().alias("avg_rating")) \
        .select(F.date_format("month", "yyyy-MM").alias("month_year"), "avg_rating")
