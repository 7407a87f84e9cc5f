"""Look-alikes over all items by score bounds, against ranking all co-ratings."""

import random

import pytest
from pyspark.sql import functions as F

from reviewgraph.operators import similarity as S
from reviewgraph.operators import uncut as N
from tests import toy


@pytest.fixture(scope="module")
def t(spark):
    """One restaurant that nearly all users rated, others with few raters, some values missing."""
    rng = random.Random(5)
    people = [(f"U{u}", rng.choice([0, 1, 5, 50, 300]), rng.choice([0, 3, 400, 2000]),
               rng.choice([0, 2, 90]), rng.choice([1.0, 2.5, 4.0, 5.0])) for u in range(250)]
    places = [(f"R{r}", rng.choice(["85001", "85002", "85003", None]), 3.5,
               rng.choice([0, 1, 4, 30, 500, None])) for r in range(120)]
    pairs = {(f"U{u}", "R0") for u in range(250) if rng.random() < 0.9}
    pairs |= {(f"U{rng.randrange(250)}", f"R{rng.randrange(120)}") for _ in range(1200)}
    reviews = [(u, r, rng.choice([1, 3, 5]), 0) for u, r in sorted(pairs)]
    full = toy.tables(spark, reviews, people, places)
    users = full.users.withColumns({
        "average_stars": F.when(F.col("id") != "U7", F.col("average_stars")),
        "review_count": F.when(F.col("id") != "U9", F.col("review_count"))})
    return full.with_tables(users=users).staged()


def same(got, want):
    columns = want.columns
    assert toy.rows(got, *columns) == toy.rows(want, *columns)


def test_users_equal_the_ranking_of_all_co_ratings(t):
    found = N.like_users_uncut(t, limit=6)
    same(found.like, S.like_users(t, limit=6, first_order=None, candidate_rows=None))
    told = {r["joined"]: r["count"] for r in found.blocks.groupBy("joined").count().collect()}
    assert told[False] > 0.1 * sum(told.values())  # these blocks were never joined


def test_restaurants_equal_the_ranking_of_all_co_ratings(t):
    found = N.like_restaurants_uncut(t, limit=6)
    same(found.like, S.like_restaurants(t, limit=6, first_order=None, candidate_rows=None))
    told = {r["joined"]: r["count"] for r in found.blocks.groupBy("joined").count().collect()}
    assert told[False] > 0.1 * sum(told.values())


def test_chosen_seeds_and_an_exclusive_limit(spark, t):
    seeds = toy.seeds(spark, "U3", "U7", "nobody")
    found = N.like_users_uncut(t, seeds, limit=4, inclusive=False)
    same(found.like, S.like_users(t, seeds, limit=4, inclusive=False, first_order=None,
                                  candidate_rows=None))
    assert found.like.select("seed_id").distinct().count() == 2


def test_bounds_hold_for_every_candidate(t):
    found = N.like_users_uncut(t, limit=10_000)
    assert found.blocks.where("NOT joined").isEmpty()  # nobody has so many: no floor
    scores = found.like.join(t.users.select(F.col("id").alias("user_id")), "user_id").select(
        "seed_id", "lmu_score", F.floor(F.col("influence_val") / N.INFLUENCE_STEP).alias("block"))
    over = scores.join(found.blocks, ["seed_id", "block"]).where("lmu_score > bound")
    assert over.isEmpty()
