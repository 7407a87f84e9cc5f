"""The node/link graph around every seed and what is read off it.

Nodes: ``seed_id, id, name, type, order, score``; links: ``seed_id, source, target, src_order,
score``. The seed is order 0 with score -1, its items are order 1, its look-alikes order 2 and
the third-order results order 3. Only look-alikes that led to a third-order result are drawn,
and only the items linked to such a look-alike.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewgraph.functions.scoring import r2

NODE = ("seed_id", "id", "name", "type", "order", "score")
LINK = ("seed_id", "source", "target", "src_order", "score")
COMPARED = 10
SEED_SCORE = -1.0


class Graph(NamedTuple):
    nodes: DataFrame
    links: DataFrame


def _node(id_: Column | str, name: str, type_: str, order: int, score: Column) -> Column:
    return F.struct(F.col(id_).alias("id"), F.col(name).alias("name"), F.lit(type_).alias("type"),
                    F.lit(order).alias("order"), score.cast("double").alias("score"))


def _link(source: str, target: str, src_order: int, score: str) -> Column:
    return F.struct(F.col(source).alias("source"), F.col(target).alias("target"),
                    F.lit(src_order).alias("src_order"),
                    F.col(score).cast("double").alias("score"))


def _spread(df: DataFrame, structs: list[Column], columns: tuple[str, ...]) -> DataFrame:
    """One output row per struct, in a single pass over ``df``, without repeats."""
    return (df.select("seed_id", F.explode(F.array(*structs)).alias("x"))
            .select("seed_id", "x.*").select(*columns).distinct())


def _graph(seeds: DataFrame, like: DataFrame, third: DataFrame, seed_type: str, item_type: str,
           item: tuple[str, str], via: tuple[str, str], via_score: str,
           third_link_score: str) -> Graph:
    """``item`` and ``via`` are (id, name) column pairs of the item and look-alike side."""
    (item_id, item_name), (via_id, via_name) = item, via
    drawn = like.join(third.select("seed_id", via_id).distinct(), ["seed_id", via_id],
                      "left_semi")
    own = seeds.select("seed_id", "name").join(third.select("seed_id").distinct(), "seed_id",
                                               "left_semi")
    nodes = (
        _spread(third, [_node(item_id, item_name, item_type, 3, F.col("relevancy")),
                        _node(via_id, via_name, seed_type, 2, F.col(via_score))], NODE)
        .unionByName(_spread(drawn, [_node(item_id, item_name, item_type, 1,
                                           F.col("sel_rating"))], NODE))
        .unionByName(_spread(own, [_node("seed_id", "name", seed_type, 0, F.lit(SEED_SCORE))],
                             NODE)))
    links = (
        _spread(third, [_link(via_id, item_id, 2, third_link_score)], LINK)
        .unionByName(_spread(drawn, [_link(item_id, via_id, 1, "sel_rating"),
                                     _link("seed_id", item_id, 0, "sel_rating")], LINK)))
    return Graph(nodes, links)


def user_graph(users: DataFrame, like_users: DataFrame, recommended: DataFrame) -> Graph:
    """Graph around every user that has recommendations. ``users`` needs id and name."""
    return _graph(users.select(F.col("id").alias("seed_id"), "name"), like_users, recommended,
                  "user", "restaurant", ("restaurant_id", "restaurant"), ("user_id", "user"),
                  "lmu_score", "lmu_rating")


def restaurant_graph(business: DataFrame, like_restaurants: DataFrame,
                     prospects: DataFrame) -> Graph:
    """Graph around every restaurant that has prospects.

    The links to prospects carry the competitor's score, not the prospect's rating.
    """
    return _graph(business.select(F.col("id").alias("seed_id"), "name"), like_restaurants,
                  prospects, "restaurant", "user", ("user_id", "user"),
                  ("restaurant_id", "restaurant"), "compete_score", "compete_score")


def comparison(nodes: DataFrame, order: int) -> DataFrame:
    """Names and scores of one order, best first, with their position per seed."""
    # a graph holds at most limit + 1 nodes of one order
    best_first = Window.partitionBy("seed_id").orderBy(F.desc("score"), F.asc("name"), F.asc("id"))
    return (nodes.where(F.col("order") == order).withColumn("score", r2(F.col("score")))
            .select("seed_id", F.row_number().over(best_first).alias("position"), "id", "name",
                    "score"))


def comparison_topk(compared: DataFrame, selected: DataFrame, k: int = COMPARED) -> DataFrame:
    """The first ``k`` rows of a comparison; a selected node further down takes the last place.

    ``selected`` holds ``seed_id, selected_id``.
    """
    node = F.struct("position", "id", "name", "score")
    # One row per seed with its whole comparison: few rows, as a graph is of bounded size.
    lists = compared.groupBy("seed_id").agg(F.array_sort(F.collect_list(node)).alias("all"))
    wanted = selected.select("seed_id", "selected_id").distinct().join(lists, "seed_id")
    own = F.get(F.filter("all", lambda x: (x["id"] == F.col("selected_id"))
                         & (x["position"] > k)), F.lit(0))
    shown = F.transform(F.filter("all", lambda x: x["position"] <= k), lambda x: F.when(
        F.col("own").isNotNull() & (x["position"] == k),
        F.struct(x["position"].alias("position"), F.col("own.id").alias("id"),
                 F.col("own.name").alias("name"), F.col("own.score").alias("score")))
        .otherwise(x))
    return (wanted.withColumn("own", own).select("seed_id", "selected_id",
                                                 F.explode(shown).alias("shown"))
            .select("seed_id", "selected_id", "shown.*"))


def path_to_root(links: DataFrame, selected: DataFrame) -> DataFrame:
    """All links on a path from the selected node back to its seed.

    ``selected`` holds ``seed_id, selected_id, order``: a user and a restaurant may carry the
    same id, so the order tells which node is meant. A graph is of bounded size: each seed's
    links travel as one list, and the walk happens inside the row, without a join per order.
    """
    link = F.struct("src_order", "source", "target", "score")
    lists = links.groupBy("seed_id").agg(F.collect_list(link).alias("links"))
    rows = (selected.select("seed_id", "selected_id", "order").distinct().join(lists, "seed_id")
            .withColumn("ends", F.array("selected_id")))
    none = F.array().cast(lists.schema["links"].dataType)
    for k in (2, 1, 0):
        # the walk begins at the node's own order
        walks = F.col("order") > k
        step = F.filter("links", lambda x: (x["src_order"] == F.lit(k))  # noqa: B023
                        & F.array_contains(F.col("ends"), x["target"]))
        rows = rows.withColumn(f"step{k}", F.when(walks, step).otherwise(none))
        sources = F.array_distinct(F.transform(f"step{k}", lambda x: x["source"]))
        rows = rows.withColumn("ends", F.when(walks, sources).otherwise(F.col("ends")))
    return (rows.select("seed_id", "selected_id",
                        F.explode(F.concat("step2", "step1", "step0")).alias("x"))
            .select("seed_id", "selected_id", "x.source", "x.target", "x.src_order", "x.score"))
