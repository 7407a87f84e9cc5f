"""Competitors, prospects and co-reviewers of chosen seeds.

Every function takes a ``seeds`` frame (``seed_id``) and walks outward with semi joins and
counts: per seed the work grows with the reviews it touches, never with pairs of reviewers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgraph.functions.ranking import top_k
from reviewgraph.operators.reduction import RESTAURANTS, with_category
from reviewgraph.sources.tables import Tables

# Fixed value: reviewers per business in an edge sample.
SAMPLED = 10


def attribute_competitors(t: Tables, seeds: DataFrame,
                          categories: Sequence[str] | DataFrame) -> DataFrame:
    """Restaurants in a seed's zip code with at least one of the categories, one row per name.

    ``categories`` is a list, the same for all seeds, or a frame ``seed_id, category``. Of
    restaurants that share a name the one with the smallest id is kept.
    """
    own = (seeds.select("seed_id").distinct()
           .join(t.business.select(F.col("id").alias("seed_id"), "postal_code"), "seed_id"))
    # By zip code first: few businesses are left when their categories are looked up.
    places = (t.business.withColumnRenamed("id", "business_id").join(own, "postal_code")
              .join(with_category(t), "business_id", "left_semi"))
    labels = t.category
    if isinstance(categories, DataFrame):
        wanted = categories.select("seed_id", "category").distinct()
        matched = places.join(labels, "business_id").join(wanted, ["seed_id", "category"])
    else:
        matched = places.join(labels.where(F.col("category").isin(list(categories))),
                              "business_id")
    kept = F.min(F.struct("business_id", "category", "neighborhood", "city"))
    return (matched.groupBy("seed_id", "name").agg(kept.alias("kept"))
            .select("seed_id", "kept.business_id", "name", "kept.neighborhood", "kept.city",
                    "kept.category"))


def own_categories(t: Tables, seeds: DataFrame) -> DataFrame:
    """The seeds' own categories other than the one all restaurants share."""
    return (t.category.where(F.col("category") != RESTAURANTS)
            .join(seeds.select(F.col("seed_id").alias("business_id")).distinct(), "business_id")
            .select(F.col("business_id").alias("seed_id"), "category"))


def new_prospects(t: Tables, competitors: DataFrame) -> DataFrame:
    """Reviewers of a seed's competitors who never reviewed the seed, each once."""
    ratings = t.review.select("user_id", "business_id")
    theirs = (ratings.join(competitors.select("seed_id", "business_id"), "business_id")
              .select("seed_id", "user_id").distinct())
    mine = ratings.withColumnRenamed("business_id", "seed_id").join(
        competitors.select("seed_id").distinct(), "seed_id", "left_semi")
    names = t.users.select(F.col("id").alias("user_id"), "name")
    return theirs.join(mine, ["seed_id", "user_id"], "left_anti").join(names, "user_id").select(
        "seed_id", "user_id", "name")


def _first_order(t: Tables, seeds: DataFrame, seed: str, other: str) -> DataFrame:
    return (t.review.select(F.col(seed).alias("seed_id"), other)
            .join(seeds.select("seed_id").distinct(), "seed_id", "left_semi").distinct())


def _step(t: Tables, reached: DataFrame, via: str, other: str) -> DataFrame:
    """The distinct ``other`` ids reviewed together with the reached ``via`` ids."""
    return (t.review.select("user_id", "business_id").join(reached, via)
            .select("seed_id", other).distinct())


def third_order_users(t: Tables, seeds: DataFrame, followed: int | None = None) -> DataFrame:
    """Reviewers of the items that a seed business's reviewers reviewed.

    With ``followed`` only each seed's top items are followed: those that most of its reviewers
    reviewed, then by id.
    """
    reviewers = _first_order(t, seeds, "business_id", "user_id")
    reached = (t.review.select("user_id", "business_id").distinct().join(reviewers, "user_id")
               .groupBy("seed_id", "business_id").agg(F.count(F.lit(1)).alias("shared")))
    items = top_k(reached, ["seed_id"], [F.desc("shared"), F.asc("business_id")], followed)
    return _step(t, items.select("seed_id", "business_id"), "business_id", "user_id")


def third_order_businesses(t: Tables, seeds: DataFrame) -> DataFrame:
    """Businesses reviewed by the users who share a business with a seed user."""
    users = _step(t, _first_order(t, seeds, "user_id", "business_id"), "business_id", "user_id")
    names = t.business.select(F.col("id").alias("business_id"), "name")
    return _step(t, users, "user_id", "business_id").join(names, "business_id").select(
        "seed_id", "business_id", "name")


def edge_sample(t: Tables, businesses: DataFrame | None = None, k: int = SAMPLED) -> DataFrame:
    """Up to ``k`` reviewers of each business, for drawing a graph elsewhere."""
    edges = t.review.select("business_id", "user_id").distinct()
    if businesses is not None:
        edges = edges.join(businesses.select("business_id").distinct(), "business_id",
                           "left_semi")
    kept = top_k(edges, ["business_id"], [F.asc("user_id")], k)
    names = t.users.select(F.col("id").alias("user_id"), "name")
    return kept.join(names, "user_id").select("business_id", "user_id", "name")


def named_reviewers(t: Tables, city: str, names: DataFrame) -> DataFrame:
    """Reviews in a city by users of the given names (column ``name``), in any case."""
    wanted = names.select(F.lower("name").alias("_name")).distinct()
    people = (t.users.select(F.col("id").alias("user_id"), "name",
                             F.lower("name").alias("_name"))
              .join(wanted, "_name", "left_semi").drop("_name"))
    places = t.business.where(F.col("city") == city).select(F.col("id").alias("business_id"))
    return (t.review.select(F.col("id").alias("review_id"), "user_id", "business_id")
            .join(places, "business_id", "left_semi").join(people, "user_id")
            .select("review_id", "user_id", "name", "business_id"))


def _co_rated(t: Tables, seeds: DataFrame, seed: str, via: str) -> DataFrame:
    """``seed_id, via, own stars`` joined to all ratings of ``via``: the seed itself included."""
    ratings = t.ratings().select("user_id", "business_id", "stars")
    own = (ratings.join(seeds.select(F.col("seed_id").alias(seed)).distinct(), seed, "left_semi")
           .select(F.col(seed).alias("seed_id"), via, F.col("stars").alias("own_stars")))
    return ratings.join(own, via)


def _ranked(rows: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    counted = rows.groupBy("seed_id", key).agg(F.count(F.lit(1)).alias("shared"))
    return (counted.join(names.select(F.col("id").alias(key), F.col("name").alias(name)), key)
            .select("seed_id", key, name, "shared").orderBy("seed_id", F.desc("shared"), key))


def co_reviewers(t: Tables, seeds: DataFrame) -> DataFrame:
    """Everyone who reviewed a seed user's restaurants, most shared ones first."""
    return _ranked(_co_rated(t, seeds, "user_id", "business_id"), "user_id", t.users, "user")


def same_rating_users(t: Tables, seeds: DataFrame) -> DataFrame:
    """As :func:`co_reviewers`, counting only restaurants rated like the seed rated them."""
    same = _co_rated(t, seeds, "user_id", "business_id").where("stars = own_stars")
    return _ranked(same, "user_id", t.users, "user")


def co_reviewed(t: Tables, seeds: DataFrame) -> DataFrame:
    """Restaurants reviewed by a seed business's reviewers, most shared ones first."""
    return _ranked(_co_rated(t, seeds, "business_id", "user_id"), "business_id", t.business,
                   "restaurant")


def same_rating_restaurants(t: Tables, seeds: DataFrame) -> DataFrame:
    """As :func:`co_reviewed`, counting only customers who gave both the same stars."""
    same = _co_rated(t, seeds, "business_id", "user_id").where("stars = own_stars")
    return _ranked(same, "business_id", t.business, "restaurant")


def review_counts(t: Tables, businesses: DataFrame | None = None) -> DataFrame:
    """Number of reviews of each chosen business (column ``business_id``), most first."""
    reviews = t.review.select("business_id", "user_id")
    if businesses is not None:
        reviews = reviews.join(businesses.select("business_id").distinct(), "business_id",
                               "left_semi")
    return (reviews.groupBy("business_id").agg(F.count("user_id").alias("reviews"))
            .orderBy(F.desc("reviews"), "business_id"))


def busiest(ratings: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The ``n`` ids of ``key`` with the most reviews, as a seeds frame."""
    return (ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(key)).limit(n).select(F.col(key).alias("seed_id")))
