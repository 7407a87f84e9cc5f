"""How a restaurant's rating develops over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_sums(review: DataFrame) -> DataFrame:
    """``business_id, day, total, rated, reviews``: what a day's mean is made of."""
    return review.groupBy("business_id", F.to_date("date").alias("day")).agg(
        F.sum("stars").alias("total"), F.count("stars").alias("rated"),
        F.count(F.lit(1)).alias("reviews"))


def merged_sums(state: DataFrame, review: DataFrame) -> DataFrame:
    """The daily sums after more reviews, of new days or of days that came before.

    Only the new reviews are read; days that they don't touch pass through one aggregation of
    rows that are few beside the reviews behind them.
    """
    return state.unionByName(daily_sums(review)).groupBy("business_id", "day").agg(
        *[F.sum(c).alias(c) for c in ("total", "rated", "reviews")])


def momentum(review: DataFrame) -> DataFrame:
    """Mean stars per business and day, and the mean of all daily means so far.

    Reviews are averaged per day before they are ordered, so a business has at most one row
    per calendar day in the window.
    """
    return momentum_of(daily_sums(review))


def momentum_of(state: DataFrame, businesses: DataFrame | None = None) -> DataFrame:
    """:func:`momentum` from daily sums, of all or of some businesses (``business_id``)."""
    if businesses is not None:
        state = state.join(businesses.select("business_id").distinct(), "business_id", "left_semi")
    daily = state.withColumn("daily", F.try_divide("total", "rated"))
    so_far = Window.partitionBy("business_id").orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return daily.select("business_id", "day", "reviews", F.round("daily", 6).alias("daily_mean"),
                        F.round(F.avg("daily").over(so_far), 6).alias("expanding_mean"))
