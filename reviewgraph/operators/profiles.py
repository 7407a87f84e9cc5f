"""Profiles of users and restaurants, and the details of single ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.functions.scoring import (
    influence_of_candidate,
    influence_of_profile,
    influence_parts,
    r2,
)
from reviewgraph.sources.tables import Tables

NO_CATEGORIES = "(No category information)"
NO_ATTRIBUTES = "(No attributes information)"


def _only(df: DataFrame, key: str, seeds: DataFrame | None) -> DataFrame:
    if seeds is None:
        return df
    ids = seeds.select(F.col("seed_id").alias(key)).distinct()
    return df.join(ids, key, "left_semi")


def votes() -> Column:
    return F.col("useful") + F.col("funny") + F.col("cool")


def with_influence(t: Tables, seeds: DataFrame | None = None) -> DataFrame:
    """Every user with friend count, the two influence values and the sub-scores.

    ``influence`` is the profile form, ``influence_val`` the form used for look-alikes.
    """
    users = _only(t.users.withColumnRenamed("id", "user_id"), "user_id", seeds)
    friends = _only(t.friend, "user_id", seeds).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("friends"))
    counted = (users.join(friends, "user_id", "left")
               .withColumn("friends", F.coalesce("friends", F.lit(0).cast("bigint")))
               .withColumn("review_likes", votes()))
    parts = influence_parts(F.col("review_count"), F.col("review_likes"), F.col("fans"),
                            F.col("friends"), F.col("average_stars"))
    return counted.select(
        "user_id", "name", F.col("review_count").alias("total_reviews"),
        F.col("average_stars").alias("avg_rating"), "yelping_since", "review_likes", "fans",
        "friends", *[r2(part).alias(name) for name, part in parts.items()],
        influence_of_profile(parts).alias("influence"),
        influence_of_candidate(parts).alias("influence_val"))


def user_profile(t: Tables, seeds: DataFrame | None = None) -> DataFrame:
    """Profile, friend count, sub-scores and influence of the seeds (default: all users)."""
    return with_influence(t, seeds).drop("influence_val")


def _csv(df: DataFrame, column: str, name: str) -> DataFrame:
    # The distinct values per business are bounded by the vocabulary; collect_set drops
    # repeats before the shuffle.
    return df.groupBy("business_id").agg(
        F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name))


def restaurant_profile(t: Tables, seeds: DataFrame | None = None) -> DataFrame:
    """Restaurant details with its categories and switched-on attributes as csv text."""
    base = _only(t.business.withColumnRenamed("id", "business_id"), "business_id", seeds)
    categories = _csv(_only(t.category, "business_id", seeds), "category", "categories")
    switched_on = _only(t.attribute, "business_id", seeds).where(F.col("value") == "1")
    attributes = _csv(switched_on, "name", "attributes")
    return (base.join(categories, "business_id", "left").join(attributes, "business_id", "left")
            .select("name", F.col("business_id").alias("restaurant_id"),
                    F.col("stars").alias("avg_rating"), F.col("review_count").alias("total_reviews"),
                    "neighborhood", "address", "city", "state", F.col("postal_code").alias("zip"),
                    F.coalesce("categories", F.lit(NO_CATEGORIES)).alias("categories"),
                    F.coalesce("attributes", F.lit(NO_ATTRIBUTES)).alias("attributes")))


def user_restaurant_rating(t: Tables, pairs: DataFrame | None = None) -> DataFrame:
    """Review details of the given (user_id, restaurant_id) pairs, default: every review."""
    reviews = t.review.withColumnRenamed("business_id", "restaurant_id")
    if pairs is not None:
        wanted = pairs.select("user_id", "restaurant_id").distinct()
        reviews = reviews.join(wanted, ["user_id", "restaurant_id"], "left_semi")
    users = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("user"))
    business = t.business.select(F.col("id").alias("restaurant_id"),
                                 F.col("name").alias("restaurant"))
    return (reviews.join(business, "restaurant_id").join(users, "user_id")
            .select("restaurant", "restaurant_id", "user", "user_id",
                    F.col("stars").alias("rating"), "date", F.col("text").alias("review"),
                    "useful", "funny", "cool"))
