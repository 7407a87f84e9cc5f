"""Third-order results: recommended restaurants and customer prospects.

Both rate items by the look-alikes' ratings, weighted with their similarity. As for the
look-alikes, the per-seed cap on rows makes an exact cut per look-alike possible: of one
look-alike's ratings only the first ``considered_rows`` plus the at most ``first_order`` excluded
ones can reach any seed's result. Where either number is None, nothing is cut there.

For all seeds a look-alike's ratings move as lists, once, by seed, and what a seed knows moves with
them. Votes are counted as whole numbers with a digit for each look-alike; who voted is read off
the few items that are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reviewgraph.functions.numbering import numbered_ids
from reviewgraph.functions.ranking import (
    LIST_ROWS,
    SLICE_ROWS,
    cap_rows,
    clip,
    dealt,
    digit_sums,
    digits,
    digits_fit,
    last_kept,
    listed,
    listed_in_parts,
    narrow_types,
    rows_by,
    side_by_side,
    spread_join,
    top_k,
    unlisted,
    up_to_cut,
)
from reviewgraph.functions.scoring import SINGLE_VOTE_WEIGHT, exact_sum, r2
from reviewgraph.operators.similarity import FIRST_ORDER
from reviewgraph.sources.staging import staged
from reviewgraph.sources.tables import Tables

# Fixed values, the defaults: nodes kept per seed and rating rows considered per seed.
RECOMMENDATION_LIMIT = 30
PROSPECT_LIMIT = 30
RECOMMENDATION_ROWS = 2000
PROSPECT_ROWS = 1000

RESTAURANT_AVERAGE = "Restaurant's Average Rating"
USER_AVERAGE = "User's Average Rating"
LARGEST = (1 << 63) - 1


def _third_order(like: DataFrame, ratings: DataFrame, side: DataFrame, names: DataFrame, via: str,
                 item: str, score: str, value: str, cap: int | None, limit: int,
                 inclusive: bool, exclude: str, first_order: int | None, few: bool) -> DataFrame:
    """Rated items of each seed's look-alikes with contribution and relevancy.

    ``ratings`` holds ``via, item, rating``. ``side`` adds ``avg_rating`` and the ``value`` that
    decides which rows stay when a seed has more than ``cap`` of them, the highest first; ``names``
    is joined to the items that are kept. For all seeds, items travel as the numbers of their ids,
    which are in the same order.
    """
    if exclude not in ("first_order", "all_reviewed"):
        raise ValueError("exclude is 'first_order' or 'all_reviewed'")
    rated = ratings.join(side, item)
    mine = like.select("seed_id", via, score).distinct()
    if not few:  # may be costly to make, and is read several times
        by_place = Window.partitionBy("seed_id").orderBy(via)
        mine = staged(mine.withColumn("place", F.row_number().over(by_place) - 1), "walking")
    if exclude == "all_reviewed":
        # What a seed has reviewed is not bounded: no cut beforehand.
        per_via = None
        known = ratings.select(F.col(via).alias("seed_id"), item).join(
            mine.select("seed_id").distinct(), "seed_id", "left_semi")
    else:
        per_via = None if cap is None or first_order is None else cap + first_order
        known = like.select("seed_id", item).distinct()

    def best(found: DataFrame, place: str) -> DataFrame:
        several = F.try_divide(F.col("sum_contribution"), F.col("sum_score"))
        single = ((F.col("avg_rating") * SINGLE_VOTE_WEIGHT + F.col("sum_contribution"))
                  / (F.col("sum_score") + SINGLE_VOTE_WEIGHT))
        relevancy = r2(F.when(F.col("votes") > 1, several).otherwise(single))
        return clip(found.withColumn("relevancy", relevancy), ["seed_id"],
                    [F.desc("relevancy"), F.desc(place)], limit, inclusive)

    if few:
        kept, place = _of_few(mine, known, rated, via, item, score, value, cap, per_via, best), item
    else:
        place, numbers = "number", numbered_ids(side, item)
        names = names.join(numbers, item)
        kept = _of_all(mine, known.join(numbers, item).drop(item),
                       rated.join(numbers, item).drop(item), via, score, value, cap, per_via, best)
    return kept.join(names, place).select(
        "seed_id", *[c for c in names.columns if c != "number"], "avg_rating", via, "rating", score,
        "contribution", "votes", "relevancy", "position")


def _contribution(score: str) -> Column:
    return r2(F.col("rating") * F.col(score))


def _counted(score: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("votes"), F.max("avg_rating").alias("avg_rating"),
            exact_sum(F.col(score)).alias("sum_score"),
            exact_sum(_contribution(score)).alias("sum_contribution")]


def _votes(via: str, score: str) -> Column:
    return F.collect_list(F.struct(via, "rating", score, _contribution(score).alias(
        "contribution"))).alias("voted")


def _by_vote(kept: DataFrame) -> DataFrame:
    return kept.withColumn("vote", F.explode("voted")).select("*", "vote.*").drop("vote", "voted")


def _of_few(mine: DataFrame, known: DataFrame, rated: DataFrame, via: str, item: str, score: str,
            value: str, cap: int | None, per_via: int | None, best: Callable) -> DataFrame:
    """The votes behind the best items of few seeds: only ratings of their look-alikes are read."""
    rated = rated.join(mine.select(via).distinct(), via, "left_semi")
    order = [F.desc(value), F.asc(item)]
    joined = spread_join(mine, top_k(rated, [via], order, per_via), via, spread="seed_id",
                         per_key=per_via)
    unknown = joined.join(known, ["seed_id", item], "left_anti")
    rows = cap_rows(unknown, ["seed_id"], [*order, F.asc(via)], cap)
    return _by_vote(best(rows.groupBy("seed_id", item).agg(*_counted(score), _votes(via, score)),
                         item))


def _of_all(walking: DataFrame, known: DataFrame, rated: DataFrame, via: str, score: str, value: str,
            cap: int | None, per_via: int | None, best: Callable) -> DataFrame:
    """The votes behind the best items of all seeds; items are there by ``number``."""
    order = [F.desc(value), F.asc("number")]
    # A look-alike's ratings move as a row for each seed; read for their number first.
    fields = [c for c in rated.columns if c != via]
    in_lists = listed_in_parts if per_via is None or per_via > LIST_ROWS else listed
    rated = staged(in_lists(top_k(rated, [via], order, per_via), via), "rated")
    nothing = {f.name: F.lit(None).cast(f.dataType)
               for f in rated.schema["_list"].dataType.elementType if f.name != "number"}
    known = staged(known.select("seed_id", "number"), "known")
    own = listed_in_parts(known.select("seed_id", *[
        nothing[f].alias(f) if f in nothing else f for f in fields]), "seed_id")
    types = narrow_types(rated.select("_list").unionByName(own.select("_list")))
    counts = rows_by(walking, rated, via, "seed_id")
    made, over = counts.agg(F.sum("_rows"), F.count_if(
        F.col("_rows") > (LARGEST if cap is None else cap))).first()
    cut = (value, "number", via)

    def rows(of: DataFrame, also: DataFrame | None) -> DataFrame:
        joined = spread_join(of, rated, via, spread="seed_id", per_key=per_via,
                             slice_rows=SLICE_ROWS if per_via else SLICE_ROWS // LIST_ROWS)
        if also is not None:
            joined = joined.unionByName(also, allowMissingColumns=True)
        return unlisted(dealt(side_by_side(joined, types), ["seed_id"], int(made or 0)), types)

    if over:  # the others have no rows to cut, and nothing to sort for it
        many = counts.where(F.col("_rows") > cap).select("seed_id")
        unknown = rows(walking.join(many, "seed_id", "left_semi"), None).join(
            known, ["seed_id", "number"], "left_anti")
        cuts = staged(last_kept(unknown, "seed_id", [*order, F.asc(via)], cut, cap), "cuts")
        found = rows(walking.join(cuts, "seed_id", "left"), own).where(
            F.col(via).isNull() | up_to_cut(cut))
    else:
        found = rows(walking, own)
    low, high = rated.select(*[f(F.col("_list")["rating"]).alias(f"_{i}") for i, f in enumerate(
        (F.array_min, F.array_max))]).agg(F.min("_0"), F.max("_1")).first()
    places = (walking.agg(F.max("place")).first()[0] or 0) + 1
    # Digits: 0 for no vote, then the ratings from the lowest on, then a vote without a rating.
    whole = rated.schema["_list"].dataType.elementType["rating"].dataType == LongType()
    low, span = low or 0, (high or 0) - (low or 0) + 2 if whole else 0
    bits = span.bit_length()
    groups = found.groupBy("seed_id", "number")
    is_known = F.max(F.col(via).isNull().cast("int")).alias("_known")

    def unknown_only(counted: DataFrame) -> DataFrame:
        return best(counted.where("_known = 0").drop("_known"), "number")

    if not whole or not digits_fit(places, bits):
        return _by_vote(unknown_only(groups.agg(is_known, *_counted(score), _votes(via, score))))
    digit = F.coalesce(F.col("rating") - low + 1, F.lit(span))
    kept = unknown_only(groups.agg(is_known, *_counted(score), *digit_sums(
        "place", digit, places, bits)))
    voters = dealt(walking.withColumnRenamed("seed_id", "_seed"), ["_seed"], int(made or 0))
    voters = voters.groupBy("_seed").agg(F.map_from_entries(F.collect_list(
        F.struct("place", F.struct(via, score)))).alias("_voters"))
    return (digits(kept.withColumnRenamed("seed_id", "_seed").join(voters, "_seed"), places, bits)
            .withColumn("rating", F.when(F.col("digit") < span, F.col("digit") + low - 1))
            .withColumn("vote", F.col("_voters")[F.col("place")]).select("*", "vote.*")
            .withColumn("contribution", _contribution(score))
            .drop("vote", "_voters", "place", "digit").withColumnRenamed("_seed", "seed_id"))


def _ratings(t: Tables) -> DataFrame:
    return t.ratings().select("user_id", F.col("business_id").alias("restaurant_id"),
                              F.col("stars").alias("rating"))


def recommended_restaurants(t: Tables, like_users: DataFrame,
                            limit: int = RECOMMENDATION_LIMIT, inclusive: bool = True,
                            exclude: str = "first_order",
                            considered_rows: int | None = RECOMMENDATION_ROWS,
                            first_order: int | None = FIRST_ORDER,
                            few: bool = False) -> DataFrame:
    """Restaurants rated by each seed's like-minded users, one row per (seed, restaurant, user).

    Left out are the first-order restaurants in ``like_users`` (``first_order`` tells how many a
    seed has there at most), or with ``exclude="all_reviewed"`` all that the seed has reviewed.
    ``considered_rows`` bounds the ratings per seed, None: no bound. ``few`` has the ratings cut to
    the look-alikes first; it changes the plan, never the rows.
    """
    places = t.business.select(F.col("id").alias("restaurant_id"), "name",
                               F.col("stars").alias("avg_rating"))
    rows = _third_order(like_users, _ratings(t), places.drop("name"),
                        places.select("restaurant_id", F.col("name").alias("restaurant")), via="user_id", item="restaurant_id", score="lmu_score",
                        value="avg_rating", cap=considered_rows, limit=limit,
                        inclusive=inclusive, exclude=exclude, first_order=first_order, few=few)
    users = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("user"))
    return (rows.join(users, "user_id")
            .select("seed_id", "restaurant", "restaurant_id", "avg_rating", "user", "user_id",
                    F.col("rating").alias("lmu_rating"), "lmu_score", "contribution",
                    "relevancy", "position"))


def customer_prospects(t: Tables, like_restaurants: DataFrame, limit: int = PROSPECT_LIMIT,
                       inclusive: bool = True, exclude: str = "first_order",
                       considered_rows: int | None = PROSPECT_ROWS,
                       first_order: int | None = FIRST_ORDER, few: bool = False) -> DataFrame:
    """Users who rated each seed's competitors, one row per (seed, user, competitor).

    The arguments are those of :func:`recommended_restaurants`.
    """
    people = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("user"),
                            F.col("average_stars").alias("avg_rating"),
                            F.col("useful").alias("usefulness"))
    rows = _third_order(like_restaurants, _ratings(t), people.drop("user"),
                        people.select("user_id", "user"), via="restaurant_id", item="user_id", score="compete_score",
                        value="usefulness", cap=considered_rows, limit=limit,
                        inclusive=inclusive, exclude=exclude, first_order=first_order, few=few)
    places = t.business.select(F.col("id").alias("restaurant_id"),
                               F.col("name").alias("restaurant"))
    return (rows.join(places, "restaurant_id")
            .select("seed_id", "user", "user_id", "avg_rating", "restaurant", "restaurant_id",
                    F.col("rating").alias("user_rating"), "compete_score", "contribution",
                    F.col("votes").alias("reviewed"), "relevancy", "position"))


def _relevance(rows: DataFrame, item: str, who: str, rating: str, score: str, caption: str,
               selected: DataFrame | None) -> DataFrame:
    rows = rows.withColumnRenamed(item, "selected_id")
    if selected is not None:
        rows = rows.join(selected.select("seed_id", "selected_id").distinct(),
                         ["seed_id", "selected_id"], "left_semi")
    votes = F.count(F.lit(1)).over(Window.partitionBy("seed_id", "selected_id"))
    own = F.struct(F.col(who).alias(who), F.col(rating).cast("double").alias(rating),
                   F.col(score).alias(score), F.col("contribution").alias("contribution"))
    average = F.struct(F.lit(caption).alias(who), F.col("avg_rating").alias(rating),
                       F.lit(float(SINGLE_VOTE_WEIGHT)).alias(score),
                       (F.col("avg_rating") * SINGLE_VOTE_WEIGHT).alias("contribution"))
    entries = F.when(F.col("_votes") == 1, F.array(own, average)).otherwise(F.array(own))
    return (rows.withColumn("_votes", votes).withColumn("entry", F.explode(entries))
            .select("seed_id", "selected_id", "entry.*", "relevancy"))


def restaurant_relevance(recommended: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """What each vote adds to a recommendation.

    A restaurant with one vote gets a second row for its average rating, which was mixed in.
    ``selected`` names (seed_id, selected_id) pairs; default: every recommendation.
    """
    return _relevance(recommended, "restaurant_id", "user", "lmu_rating", "lmu_score",
                      RESTAURANT_AVERAGE, selected)


def prospect_relevance(prospects: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """What each rated competitor adds to a prospect's relevancy."""
    return _relevance(prospects, "user_id", "restaurant", "user_rating", "compete_score",
                      USER_AVERAGE, selected)


def relevance_totals(relevance: DataFrame, score: str) -> DataFrame:
    """The two closing rows under a relevance table: the totals and their ratio."""
    sums = relevance.groupBy("seed_id", "selected_id").agg(
        exact_sum(F.col(score)).alias("similarity"),
        F.sum(F.col("contribution").cast("decimal(28,6)")).cast("double").alias("contribution"),
        F.max("relevancy").alias("relevancy"))
    lines = F.array(
        F.struct(F.lit("Totals").alias("line"), F.col("similarity").alias("similarity"),
                 F.round("contribution", 6).alias("contribution")),
        F.struct(F.lit("Contribution / Similarity").alias("line"),
                 F.lit(None).cast("double").alias("similarity"),
                 F.col("relevancy").alias("contribution")))
    return sums.select("seed_id", "selected_id", F.explode(lines).alias("row")).select(
        "seed_id", "selected_id", "row.*")
