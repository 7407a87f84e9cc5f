"""Scored rows move once, by seed, into tasks of bounded size."""

import toy
from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewgraph.functions import ranking
from reviewgraph.operators import recommend as R
from reviewgraph.operators import similarity as S


def steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_into_bounded_tasks(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("seed_id"), "id")
    dealt = ranking.dealt(rows, ["seed_id"], 1000, task_rows=100)
    first = F.row_number().over(Window.partitionBy("seed_id").orderBy("id"))
    found = dealt.withColumn("place", first).groupBy("seed_id", "place").count()
    assert steps(found).count("Exchange") == 1
    assert dealt.rdd.getNumPartitions() == 10
    assert found.count() == 1000
    other = spark.range(100).select((F.col("id") % 4).alias("seed_id"))
    assert ranking.made_rows(rows, other, "seed_id") == 4 * 20 * 25
    assert ranking.made_rows(rows.where("false"), other, "seed_id") == 0


def test_candidates_are_scored_where_they_are_counted(spark):
    """No join or exchange by seed between the candidates' rows and the clip."""
    t = toy.tables(spark)
    for like in (S.like_users(t), S.like_restaurants(t)):
        assert "Join [seed_id" not in steps(like)
        assert steps(like).count("hashpartitioning(seed_id") == 1


def test_third_order_rows_are_read_for_their_number_first(spark, monkeypatch):
    t = toy.tables(spark)
    like, asked = S.like_users(t), []
    monkeypatch.setattr(R, "dealt", lambda df, by, rows: asked.append(rows) or df)
    whole = toy.rows(R.recommended_restaurants(t, like))
    assert asked and asked[0] > 0
    monkeypatch.undo()
    assert toy.rows(R.recommended_restaurants(t, like)) == whole


def test_lists_move_instead_of_rows(spark):
    """What meets a seed by one item crosses the exchange by seed as one row."""
    rows = spark.createDataFrame([("a", "x", 1, None), ("a", "y", 2, 0.5), ("b", "z", None, 1.5)],
                                 "key string, who string, n int, score double")
    lists = ranking.listed(rows, "key")
    assert lists.count() == 2
    again = ranking.unlisted(ranking.side_by_side(lists))
    assert again.columns == rows.columns and toy.rows(again) == toy.rows(rows)
    seeds = spark.createDataFrame([("s", "a"), ("t", "a"), ("t", "b")], "seed_id string, key string")
    assert ranking.made_rows(seeds, lists, "key", F.sum(F.size("_list"))) == 5
    t = toy.tables(spark)
    like = S.like_users(t)
    for found in (like, S.like_restaurants(t), R.recommended_restaurants(t, like)):
        plan = steps(found)
        assert plan.index("Generate inline") < plan.index("Exchange hashpartitioning(seed_id")


def test_hot_keys_do_not_move_the_others(spark):
    """The few hot keys are broadcast: both sides move once, by key and slice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(1000).select((F.col("id") % 7).alias("key"), "id")
        one = spark.range(7).select(F.col("id").alias("key"))
        joined = ranking.spread_join(many, one, "key", spread="id", per_key=1, slice_rows=100)
        assert steps(joined).count("SortMergeJoin") == 1
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
