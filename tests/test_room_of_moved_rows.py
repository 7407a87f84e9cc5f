"""What moves takes little room, and what has moved does not stay on disk."""

import time

import toy
from pyspark.sql import functions as F

from reviewgraph.functions import ranking
from reviewgraph.functions.numbering import numbered_ids
from reviewgraph.operators import recommend as R
from reviewgraph.operators import similarity as S
from reviewgraph.sources import staging


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    return manager.diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")


def test_written_steps_leave_no_shuffle_files(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    rows.collect()
    plain = shuffle_files(spark)
    assert plain > 0
    kept = staging.staged(rows, "counts")
    deadline = time.time() + 20
    while shuffle_files(spark) > plain and time.time() < deadline:
        time.sleep(0.2)  # files are deleted in the background
    assert shuffle_files(spark) <= plain
    assert kept.count() == 7
    assert spark.conf.get(staging.CLEANUP, None) in (None, "false")


def test_whole_numbers_travel_narrow_and_come_back(spark):
    rows = spark.createDataFrame(
        [(1, 127, 128, -(1 << 15) - 1, 1 << 40, None, 0.5), (1, -128, 0, 0, 0, None, None),
         (2, None, 5, 7, 9, None, 1.5)],
        "k long, a long, b long, c long, d long, e long, x double")
    lists = ranking.listed(rows, "k")
    types = ranking.narrow_types(lists)
    assert types == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "tinyint"}
    back = ranking.unlisted(ranking.side_by_side(lists, types), types)
    assert back.schema == rows.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert ranking.narrow_types(lists.where("false")) == dict.fromkeys("abcde", "tinyint")


def test_numbers_are_in_the_order_of_their_ids(spark):
    ids = spark.createDataFrame([("9",), ("10",), ("b",), (None,), ("10",)], "id string")
    assert {r["id"]: r["number"] for r in numbered_ids(ids, "id").collect()} == {
        "10": 1, "9": 2, "b": 3}


def test_no_ids_in_the_lists_that_move_by_seed(spark, monkeypatch):
    t, seen = toy.tables(spark), []

    def watched(df, types=None):
        seen.append(df.schema["_list"].dataType.elementType.simpleString())
        return ranking.side_by_side(df, types)

    monkeypatch.setattr(S, "side_by_side", watched)
    monkeypatch.setattr(R, "side_by_side", watched)
    R.recommended_restaurants(t, S.like_users(t))
    R.customer_prospects(t, S.like_restaurants(t))
    assert len(seen) == 4 and not any("string" in fields for fields in seen)
