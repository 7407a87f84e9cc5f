"""Profiles, look-alikes, recommendations and graphs on the toy tables."""

import pytest

from reviewgraph.operators import graph as G
from reviewgraph.operators import profiles as P
from reviewgraph.operators import recommend as R
from reviewgraph.operators import similarity as S
from reviewgraph.plans import explore as X
from tests import toy


@pytest.fixture(scope="module")
def t(spark):
    return toy.tables(spark)


@pytest.fixture(scope="module")
def user0(spark, t):
    return X.explore_user(t, toy.seeds(spark, "U0"))


@pytest.fixture(scope="module")
def rest1(spark, t):
    return X.explore_restaurant(t, toy.seeds(spark, "R1"))


def test_profile(t):
    got = toy.rows(P.user_profile(t), "user_id", "total_reviews_score", "review_likes_score",
                   "fans_score", "friends_score", "avg_rating_score", "influence", "friends")
    assert got == [("U0", .23, .30, .22, .18, .73, 1.66, 2), ("U1", .40, .66, .36, .12, .80, 2.34, 1),
                   ("U2", .12, .0, .0, .0, 1.0, 1.12, 0), ("U3", .62, .49, .14, .0, .60, 1.85, 0)]
    assert toy.rows(P.with_influence(t), "user_id", "influence_val") == [
        ("U0", 1.66), ("U1", 2.33), ("U2", 1.12), ("U3", 1.85)]


def test_unknown_seed_has_no_profile(spark, t):
    assert P.user_profile(t, toy.seeds(spark, "nobody")).count() == 0


def test_restaurant_profile(spark, t):
    got = toy.rows(P.restaurant_profile(t, toy.seeds(spark, "R1", "R2", "R4")), "restaurant_id",
                   "zip", "categories", "attributes")
    assert got == [("R1", "85001", "Pizza,Restaurants", "Alcohol,WiFi"),
                   ("R2", "85001", "Food,Restaurants", P.NO_ATTRIBUTES),
                   ("R4", "85002", P.NO_CATEGORIES, P.NO_ATTRIBUTES)]


def test_like_users(user0):
    got = toy.rows(S.user_similarity(user0.like).drop("seed_id"))
    assert got == [
        ("U1", 2, .40, "2 / 13", .78, "7 / 8", .88, 2.33, .47, "1.66 / 2.33", .71, 3.24),
        ("U2", 1, .20, "1 / 4", .72, "2 / 5", .40, 1.12, .22, "1.12 / 1.66", .67, 2.21),
        ("U3", 1, .20, "1 / 43", .27, "1 / 3", .33, 1.85, .37, "1.66 / 1.85", .90, 2.07)]
    assert toy.rows(user0.like, "user_id", "restaurant_id", "sel_rating") == [
        ("U1", "R1", 5), ("U1", "R2", 3), ("U2", "R1", 5), ("U3", "R2", 3)]


def test_like_restaurants(rest1):
    got = toy.rows(S.restaurant_similarity(rest1.like), "selected_id", "shared_val", "shared_score",
                   "overlap_score", "review_sim_score", "rate_sim_val", "rate_sim_score",
                   "zip_score", "compete_score")
    assert got == [("R2", 2, .20, .21, .79, "6 / 9", .67, 1, 2.87),
                   ("R3", 1, .10, .12, .63, "4 / 5", .80, 0, 1.65),
                   ("R4", 1, .10, .14, .00, "2 / 4", .50, 0, 0.74)]


def test_recommended(user0):
    assert toy.rows(user0.third, "restaurant_id", "user_id", "contribution", "relevancy") == [
        ("R3", "U1", 16.20, 4.22), ("R3", "U3", 6.21, 4.22), ("R4", "U2", 8.84, 3.31),
        ("R5", "U3", 10.35, 5.00)]


def test_prospects(rest1):
    assert toy.rows(rest1.third, "user_id", "restaurant_id", "contribution", "reviewed",
                    "relevancy") == [("U3", "R2", 2.87, 2, 1.73), ("U3", "R3", 4.95, 2, 1.73)]


def test_user_graph(user0):
    assert toy.rows(user0.graph.nodes, "id", "type", "order", "score") == [
        ("R1", "restaurant", 1, 5.0), ("R2", "restaurant", 1, 3.0), ("R3", "restaurant", 3, 4.22),
        ("R4", "restaurant", 3, 3.31), ("R5", "restaurant", 3, 5.0), ("U0", "user", 0, -1.0),
        ("U1", "user", 2, 3.24), ("U2", "user", 2, 2.21), ("U3", "user", 2, 2.07)]
    assert toy.rows(user0.graph.links, "source", "target", "src_order", "score") == [
        ("R1", "U1", 1, 5.0), ("R1", "U2", 1, 5.0), ("R2", "U1", 1, 3.0), ("R2", "U3", 1, 3.0),
        ("U0", "R1", 0, 5.0), ("U0", "R2", 0, 3.0), ("U1", "R3", 2, 5.0), ("U2", "R4", 2, 4.0),
        ("U3", "R3", 2, 3.0), ("U3", "R5", 2, 5.0)]


def test_restaurant_graph_drops_what_led_nowhere(rest1):
    assert toy.rows(rest1.graph.nodes, "id", "order", "score") == [
        ("R1", 0, -1.0), ("R2", 2, 2.87), ("R3", 2, 1.65), ("U0", 1, 5.0), ("U1", 1, 4.0),
        ("U3", 3, 1.73)]
    assert toy.rows(rest1.graph.links, "source", "target", "src_order", "score") == [
        ("R1", "U0", 0, 5.0), ("R1", "U1", 0, 4.0), ("R2", "U3", 2, 2.87), ("R3", "U3", 2, 1.65),
        ("U0", "R2", 1, 5.0), ("U1", "R2", 1, 4.0), ("U1", "R3", 1, 4.0)]


def test_path_to_root(spark, user0):
    selected = spark.createDataFrame([("U0", "R4", 3), ("U0", "U3", 2), ("U0", "R1", 1)],
                                     "seed_id string, selected_id string, order int")
    got = G.path_to_root(user0.graph.links, selected)
    assert toy.rows(got, "selected_id", "source", "target") == [
        ("R1", "U0", "R1"), ("R4", "R1", "U2"), ("R4", "U0", "R1"), ("R4", "U2", "R4"),
        ("U3", "R2", "U3"), ("U3", "U0", "R2")]


def test_comparison_keeps_the_selected_node(spark, user0):
    compared = G.comparison(user0.graph.nodes, 2)
    assert toy.rows(compared, "position", "id") == [(1, "U1"), (2, "U2"), (3, "U3")]
    selected = spark.createDataFrame([("U0", "U3"), ("U0", "U1"), ("U0", "gone")],
                                     "seed_id string, selected_id string")
    assert toy.rows(G.comparison_topk(compared, selected, 2), "selected_id", "position", "id") == [
        ("U1", 1, "U1"), ("U1", 2, "U2"), ("U3", 1, "U1"), ("U3", 2, "U3"),
        ("gone", 1, "U1"), ("gone", 2, "U2")]


def test_relevance_of_a_single_vote(spark, user0):
    selected = spark.createDataFrame([("U0", "R4"), ("U0", "R3")],
                                     "seed_id string, selected_id string")
    got = R.restaurant_relevance(user0.third, selected)
    assert toy.rows(got.drop("seed_id")) == [
        ("R3", "U1", 5.0, 3.24, 16.20, 4.22), ("R3", "U3", 3.0, 2.07, 6.21, 4.22),
        ("R4", R.RESTAURANT_AVERAGE, 3.0, 5.0, 15.0, 3.31), ("R4", "U2", 4.0, 2.21, 8.84, 3.31)]
    totals = R.relevance_totals(got, "lmu_score")
    assert toy.rows(totals.where("selected_id = 'R4'"), "line", "contribution") == [
        ("Contribution / Similarity", 3.31), ("Totals", 23.84)]


def test_node_details(spark, t, user0, rest1):
    def pair(a, b):
        return spark.createDataFrame([(a, b)], "seed_id string, selected_id string")

    detail = X.rating_of_restaurant(t, user0, pair("U0", "R1"))
    assert toy.rows(detail.detail, "restaurant", "user", "rating") == [("R1", "U0", 5)]
    assert toy.rows(detail.comparison, "name", "score") == [("R1", 5.0), ("R2", 3.0)]
    assert toy.rows(detail.like_nodes, "id", "score") == [("R2", 2.87), ("R3", 1.65), ("R4", .74)]
    detail = X.rating_by_user(t, rest1, pair("R1", "U0"))
    assert toy.rows(detail.detail, "restaurant", "user", "rating") == [("R1", "U0", 5)]
    assert [r[0] for r in toy.rows(detail.like_nodes, "id")] == ["U1", "U2", "U3"]
    assert X.likeminded_user_similarity(t, user0, pair("U0", "U1")).detail.count() == 1
    assert X.direct_competitor_similarity(t, rest1, pair("R1", "R2")).detail.count() == 1
    assert X.recommended_restaurant_relevance(t, user0, pair("U0", "R4")).detail.count() == 2
    assert X.customer_prospect_relevance(t, rest1, pair("R1", "U3")).detail.count() == 2


def test_all_seeds_give_the_same_as_one_by_one(spark, t):
    whole = X.explore_user(t)
    for seed in ("U0", "U1", "U2", "U3"):
        one = X.explore_user(t, toy.seeds(spark, seed))
        for a, b in ((whole.like, one.like), (whole.third, one.third),
                     (whole.graph.nodes, one.graph.nodes), (whole.graph.links, one.graph.links)):
            assert toy.rows(a.where(a.seed_id == seed)) == toy.rows(b)
    whole = X.explore_restaurant(t)
    one = X.explore_restaurant(t, toy.seeds(spark, "R2"))
    assert toy.rows(whole.third.where("seed_id = 'R2'")) == toy.rows(one.third)
