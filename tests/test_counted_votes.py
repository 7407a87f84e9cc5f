"""Votes and shared items of all seeds are counted in whole numbers and read off afterwards."""

import re

import toy
from pyspark.sql import functions as F

from reviewgraph.functions import ranking
from reviewgraph.operators import recommend as R
from reviewgraph.operators import similarity as S
from reviewgraph.plans import explore as X


def steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_collected_for_each_rater_or_item(spark):
    t = toy.tables(spark)
    like = S.like_users(t)
    for found in (like, S.like_restaurants(t), R.recommended_restaurants(t, like),
                  R.recommended_restaurants(t, like, exclude="all_reviewed")):
        plan = steps(found)
        assert not re.search(r"ObjectHashAggregate\(keys=\[seed_id#\d+, number", plan)
        assert re.search(r" HashAggregate\(keys=\[seed_id#\d+, number", plan)
        assert "LeftAnti" not in plan


def test_digits_come_back_from_their_sums(spark):
    rows = [(g, p, 1 + (p * g) % 6) for g in (1, 2, 5) for p in range(g % 3, 45, g)]
    df = spark.createDataFrame(rows, "g int, place int, d int")
    sums = df.groupBy("g").agg(*ranking.digit_sums("place", F.col("d"), 45, 3))
    assert sums.columns == ["g", "_digits0", "_digits1", "_digits2"]
    assert toy.rows(ranking.digits(sums, 45, 3), "g", "place", "digit") == sorted(rows)
    assert ranking.digits_fit(45, 3) and not ranking.digits_fit(10_000, 3)
    assert not ranking.digits_fit(2, 63)


def test_rows_up_to_the_cut_are_those_under_the_cap(spark):
    rows = spark.createDataFrame(
        [("s", v, n, i) for v in (None, 0.5, 2.0) for n in (1, 2) for i in ("a", "b")]
        + [("t", 1.0, 1, "a")], "seed string, value double, number long, id string")
    order = [F.desc("value"), F.asc("number"), F.asc("id")]
    for cap in range(1, 13):
        cut = ranking.last_kept(rows, "seed", order, ("value", "number", "id"), cap)
        kept = rows.join(cut, "seed", "left").where(
            ranking.up_to_cut(("value", "number", "id"))).drop("_cut")
        assert sorted(map(str, kept.collect())) == sorted(
            map(str, ranking.cap_rows(rows, ["seed"], order, cap).collect()))


def test_long_lists_are_in_parts(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 90, "a").otherwise("b").alias("k"), "id")
    lists = ranking.listed_in_parts(rows, "k", most=20)
    assert lists.columns == ["k", "_list"]
    sizes = {k: lists.where(F.col("k") == k).count() for k in "ab"}
    assert 1 < sizes["a"] <= 5 and sizes["b"] == 1
    assert lists.select(F.explode("_list.id")).distinct().count() == 100


def test_more_voters_than_digits_hold_and_votes_without_stars(spark, monkeypatch):
    reviews = [(f"U{u}", f"R{b}", (u * b) % 5 + 1 if u % 7 else None, b % 3)
               for u in range(30) for b in range(12) if (u * 7 + b) % 3]
    t = toy.tables(spark, reviews, [(f"U{u}", u, u % 4, 0, 3.0) for u in range(30)],
                   [(f"R{b}", "85001", 3.5, b) for b in range(12)], [])
    like = S.like_users(t, limit=25, first_order=2).localCheckpoint()
    for exclude in ("first_order", "all_reviewed"):
        args = {"limit": 5, "considered_rows": 150, "exclude": exclude}
        few = toy.rows(R.recommended_restaurants(t, like, few=True, **args).fillna(-1))
        assert few and any(r[6] == -1 for r in few)
        assert toy.rows(R.recommended_restaurants(t, like, **args).fillna(-1)) == few
        monkeypatch.setattr(R, "digits_fit", lambda places, bits: False)
        assert toy.rows(R.recommended_restaurants(t, like, **args).fillna(-1)) == few
        monkeypatch.undo()


def test_many_chosen_seeds_are_computed_as_all_are(spark, monkeypatch):
    t = toy.tables(spark)
    for like, ids in ((S.like_users, ("U0", "U3")), (S.like_restaurants, ("R1", "R3"))):
        seeds = toy.seeds(spark, *ids)
        many = like(t, seeds, few=False)
        assert toy.rows(many) == toy.rows(like(t, seeds))
        assert "Generate inline" in steps(many)
    explored = X.explore_user(t)
    selected = explored.graph.nodes.where("order = 2").select(
        "seed_id", F.col("id").alias("selected_id"))
    few = X.likeminded_user_similarity(t, explored, selected).like_nodes
    monkeypatch.setattr(X, "FEW_SEEDS", 1)
    many = X.likeminded_user_similarity(t, explored, selected).like_nodes
    assert "Generate inline" in steps(many) and "Generate inline" not in steps(few)
    assert few.count() and toy.rows(many) == toy.rows(few)
