"""Everything shown around a seed: profile, graph, look-alikes, and what a click on one of the
graph's nodes brings up.

An exploration computes the look-alikes and third-order results once, writes them to the shared
folder and derives all views from these two tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgraph.operators.graph import Graph, comparison, restaurant_graph, user_graph
from reviewgraph.operators.profiles import (
    restaurant_profile,
    user_profile,
    user_restaurant_rating,
)
from reviewgraph.operators.recommend import (
    customer_prospects,
    prospect_relevance,
    recommended_restaurants,
    restaurant_relevance,
)
from reviewgraph.operators.similarity import (
    like_restaurant_nodes,
    like_restaurants,
    like_user_nodes,
    like_users,
    restaurant_similarity,
    user_similarity,
)
from reviewgraph.sources.staging import staged
from reviewgraph.sources.tables import Tables

# Up to so many selected nodes, only what their own look-alikes touch is read.
FEW_SEEDS = 1000


class Exploration(NamedTuple):
    """All frames carry ``seed_id``, except the profile, which has the id under its own name."""

    profile: DataFrame
    like: DataFrame
    third: DataFrame
    graph: Graph
    like_nodes: DataFrame


class NodeDetail(NamedTuple):
    """What one selected node shows: its detail table, the comparison of its order, and its own
    look-alikes."""

    detail: DataFrame
    comparison: DataFrame
    like_nodes: DataFrame


def explore_user(t: Tables, seeds: DataFrame | None = None,
                 folder: str | None = None) -> Exploration:
    """Runs: the look-alikes and recommendations are written to ``folder`` (default: the shared
    one, until it is released)."""
    t = t.prepared() if seeds is None else t
    like = staged(like_users(t, seeds), "like_users", folder)
    third = staged(recommended_restaurants(t, like, few=seeds is not None), "recommended", folder)
    return Exploration(user_profile(t, seeds), like, third, user_graph(t.users, like, third),
                       like_user_nodes(like))


def explore_restaurant(t: Tables, seeds: DataFrame | None = None,
                       folder: str | None = None) -> Exploration:
    """As :func:`explore_user`, for restaurants."""
    t = t.prepared() if seeds is None else t
    like = staged(like_restaurants(t, seeds), "like_restaurants", folder)
    third = staged(customer_prospects(t, like, few=seeds is not None), "prospects", folder)
    return Exploration(restaurant_profile(t, seeds), like, third,
                       restaurant_graph(t.business, like, third), like_restaurant_nodes(like))


def _as_seeds(selected: DataFrame) -> tuple[DataFrame, bool]:
    """The selected nodes as seeds, and whether they are few."""
    seeds = staged(selected.select(F.col("selected_id").alias("seed_id")).distinct(), "seeds")
    return seeds, seeds.count() <= FEW_SEEDS


def _own_like_users(t: Tables, selected: DataFrame) -> DataFrame:
    seeds, few = _as_seeds(selected)
    return like_user_nodes(like_users(t, seeds, few=few))


def _own_like_restaurants(t: Tables, selected: DataFrame) -> DataFrame:
    seeds, few = _as_seeds(selected)
    return like_restaurant_nodes(like_restaurants(t, seeds, few=few))


# ``selected`` always holds the (seed_id, selected_id) pairs that were clicked.

def rating_of_restaurant(t: Tables, explored: Exploration, selected: DataFrame) -> NodeDetail:
    """A first-order restaurant of a user: the user's review of it."""
    pairs = selected.select(F.col("seed_id").alias("user_id"),
                            F.col("selected_id").alias("restaurant_id"))
    return NodeDetail(user_restaurant_rating(t, pairs), comparison(explored.graph.nodes, 1),
                      _own_like_restaurants(t, selected))


def rating_by_user(t: Tables, explored: Exploration, selected: DataFrame) -> NodeDetail:
    """A first-order user of a restaurant: that user's review of the restaurant."""
    pairs = selected.select(F.col("selected_id").alias("user_id"),
                            F.col("seed_id").alias("restaurant_id"))
    return NodeDetail(user_restaurant_rating(t, pairs), comparison(explored.graph.nodes, 1),
                      _own_like_users(t, selected))


def likeminded_user_similarity(t: Tables, explored: Exploration,
                               selected: DataFrame) -> NodeDetail:
    """A second-order user of a user: why the two are alike."""
    return NodeDetail(user_similarity(explored.like, selected),
                      comparison(explored.graph.nodes, 2), _own_like_users(t, selected))


def direct_competitor_similarity(t: Tables, explored: Exploration,
                                 selected: DataFrame) -> NodeDetail:
    """A second-order restaurant of a restaurant: why the two compete."""
    return NodeDetail(restaurant_similarity(explored.like, selected),
                      comparison(explored.graph.nodes, 2), _own_like_restaurants(t, selected))


def recommended_restaurant_relevance(t: Tables, explored: Exploration,
                                     selected: DataFrame) -> NodeDetail:
    """A third-order restaurant of a user: the votes behind the recommendation."""
    return NodeDetail(restaurant_relevance(explored.third, selected),
                      comparison(explored.graph.nodes, 3), _own_like_restaurants(t, selected))


def customer_prospect_relevance(t: Tables, explored: Exploration,
                                selected: DataFrame) -> NodeDetail:
    """A third-order user of a restaurant: the ratings behind the prospect."""
    return NodeDetail(prospect_relevance(explored.third, selected),
                      comparison(explored.graph.nodes, 3), _own_like_users(t, selected))
