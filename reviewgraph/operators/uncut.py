"""Look-alikes over all items and all ratings, for all seeds, by bounds on the score.

Candidates are dealt into blocks by what their scores depend on besides the shared items:
users by influence, restaurants by zip code and number of reviews. A seed reaches a block through
those of its items that anybody in the block rated. The best score that a block can hold follows
from their number and the block's ranges; it stands on a join with the blocks of an item, of which
there are few however many raters the item has. Each seed's best blocks are scored first. The last
place of what they give is its floor, and blocks whose bound is below it are never joined. The
result is that of :mod:`similarity` without its cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.functions.ranking import clip, rank_within, spread_join
from reviewgraph.functions.scoring import (
    CUSTOMER_OVERLAP_DIVISOR,
    SHARED_CUSTOMERS_FULL,
    SHARED_RESTAURANTS_FULL,
    log_ratio_score,
    overlap_score,
    r2,
    ratio_score,
    share_score,
)
from reviewgraph.operators.profiles import with_influence
from reviewgraph.operators.similarity import (
    LIKE_LIMIT,
    agreement,
    places_of,
    restaurant_scores,
    shown_restaurants,
    shown_users,
    user_scores,
)
from reviewgraph.sources.staging import staged
from reviewgraph.sources.tables import Tables

# Blocks scored before there is a floor; steps of influence and of the logarithm of reviews that
# make a block.
FIRST_BLOCKS = 4
INFLUENCE_STEP = 0.05
REVIEWS_STEP = 0.5
# Above every score: the bound of blocks with missing values.
NO_BOUND = 100.0


class Uncut(NamedTuple):
    """``like``, the look-alikes, and ``blocks``: seed_id, block, bound and whether it was joined."""

    like: DataFrame
    blocks: DataFrame


def _best(links: DataFrame, raters: DataFrame, item: str, rater: str,
          bounded: Callable[[DataFrame], DataFrame], scored: Callable[[DataFrame], DataFrame],
          score: str, limit: int, inclusive: bool) -> tuple[DataFrame, DataFrame]:
    """The best (seed, rater) rows of links (seed_id, item, sel_rating) and raters (item, rater,
    stars, block), and the blocks."""
    keep = limit + 1 if inclusive else limit
    raters = staged(raters.withColumn("_place", F.struct(item, "block")), "raters")
    present = raters.select(item, "block", "_place").distinct()
    reached = staged(spread_join(links, present, item, spread="seed_id"), "reached")
    reach = reached.groupBy("seed_id", "block").agg(F.count(F.lit(1)).alias("reach"))
    blocks = staged(bounded(reach).select(
        "seed_id", "block", F.coalesce("bound", F.lit(NO_BOUND)).alias("bound")), "blocks")

    def scores(chosen: DataFrame) -> DataFrame:
        mine = reached.join(chosen.select("seed_id", "block"), ["seed_id", "block"], "left_semi")
        rows = spread_join(mine.select("seed_id", item, "sel_rating", "_place"),
                           raters.select(rater, "stars", "_place"), "_place", spread="seed_id")
        return scored(agreement(rows.where(F.col(rater) != F.col("seed_id")), item, rater))

    order = [F.desc(score), F.desc(rater)]
    first = staged(rank_within(blocks, ["seed_id"], [F.desc("bound"), F.desc("block")],
                               FIRST_BLOCKS).select("seed_id", "block"), "first")
    one = staged(scores(first), "scores")
    floors = (rank_within(one, ["seed_id"], order, keep, "position")
              .where(F.col("position") == keep).select("seed_id", F.col(score).alias("floor")))
    others = blocks.join(first, ["seed_id", "block"], "left_anti").join(floors, "seed_id", "left")
    joined = F.coalesce(F.col("bound") >= F.col("floor"), F.lit(True))
    others = staged(others.withColumn("joined", joined).drop("floor"), "others")
    both = one.unionByName(scores(others.where("joined")))
    told = others.unionByName(blocks.join(first, ["seed_id", "block"], "left_semi").withColumn(
        "joined", F.lit(True)))
    return clip(both, ["seed_id"], order, limit, inclusive), told


def _nearest(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(value, high), low)


def _links(t: Tables, seed: str, item: str, seeds: DataFrame | None) -> DataFrame:
    wanted = None if seeds is None else seeds.select(F.col("seed_id").alias(seed)).distinct()
    return t.ratings(wanted).select(F.col(seed).alias("seed_id"), item,
                                    F.col("stars").alias("sel_rating"))


def like_users_uncut(t: Tables, seeds: DataFrame | None = None, limit: int = LIKE_LIMIT,
                     inclusive: bool = True) -> Uncut:
    """As ``like_users`` with ``first_order=None, candidate_rows=None``."""
    people = staged(with_influence(t).withColumn("block", F.coalesce(
        F.floor(F.col("influence_val") / INFLUENCE_STEP), F.lit(-1))), "people")
    # A missing count scores as full overlap; so does its block.
    least = F.when(F.count("total_reviews") == F.count(F.lit(1)), F.min("total_reviews"))
    ranges = people.groupBy("block").agg(
        F.min("influence_val").alias("low"), F.max("influence_val").alias("high"),
        least.alias("least"))
    own = people.select(F.col("user_id").alias("seed_id"),
                        F.col("total_reviews").alias("sel_reviews"),
                        F.col("influence").alias("sel_influ"))

    def bounded(reach: DataFrame) -> DataFrame:
        nearest = _nearest(F.col("sel_influ"), F.col("low"), F.col("high"))
        bound = r2(
            overlap_score(F.col("reach"), F.col("least") + F.col("sel_reviews")) + F.lit(1.0)
            + share_score(F.col("reach"), SHARED_RESTAURANTS_FULL) + r2(F.col("high") / 5)
            + ratio_score(F.least(nearest, "sel_influ"), F.greatest(nearest, "sel_influ")))
        return (reach.join(ranges, "block").join(own, "seed_id")
                .withColumn("bound", F.when(F.col("block") >= 0, bound)))

    raters = t.ratings().select("business_id", "user_id", "stars").join(
        people.select("user_id", "block"), "user_id")
    best, blocks = _best(_links(t, "user_id", "business_id", seeds), raters, "business_id",
                         "user_id", bounded, lambda rows: user_scores(rows, people), "lmu_score",
                         limit, inclusive)
    return Uncut(shown_users(t, best), blocks)


def like_restaurants_uncut(t: Tables, seeds: DataFrame | None = None, limit: int = LIKE_LIMIT,
                           inclusive: bool = True) -> Uncut:
    """As ``like_restaurants`` with ``first_order=None, candidate_rows=None``."""
    level = F.when(F.col("reviews").isNull(), F.lit(-1)).otherwise(
        F.floor(F.ln(F.greatest(F.col("reviews"), F.lit(1))) / REVIEWS_STEP))
    places = staged(places_of(t).withColumn("block", F.concat_ws(
        "/", F.coalesce("zip", F.lit("")), level.cast("string"))), "places")
    ranges = places.groupBy("block").agg(
        F.min("zip").alias("block_zip"), F.min("reviews").alias("low"),
        F.max("reviews").alias("high"), F.count("reviews").alias("known"))
    own = places.select(F.col("business_id").alias("seed_id"), F.col("zip").alias("sel_zip"),
                        F.col("reviews").alias("sel_reviews"))

    def bounded(reach: DataFrame) -> DataFrame:
        nearest = _nearest(F.col("sel_reviews"), F.col("low"), F.col("high"))
        same_zip = F.coalesce(F.col("block_zip") == F.col("sel_zip"), F.lit(False))
        bound = r2(
            F.lit(1.0) + share_score(F.col("reach"), SHARED_CUSTOMERS_FULL)
            + overlap_score(F.col("reach"), F.col("low") + F.col("sel_reviews"),
                            CUSTOMER_OVERLAP_DIVISOR)
            + log_ratio_score(nearest, F.col("sel_reviews")) + F.when(same_zip, 1).otherwise(0))
        return reach.join(ranges, "block").join(own, "seed_id").withColumn(
            "bound", F.when(F.col("known") > 0, bound))

    rated = t.ratings().select("user_id", "business_id", "stars").join(
        places.select("business_id", "block"), "business_id")
    best, blocks = _best(_links(t, "business_id", "user_id", seeds), rated, "user_id",
                         "business_id", bounded,
                         lambda rows: restaurant_scores(rows, places.drop("block")),
                         "compete_score", limit, inclusive)
    return Uncut(shown_restaurants(t, best), blocks)
