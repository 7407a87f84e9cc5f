"""Running numbers over whole tables."""

from pyspark.sql import functions as F

from reviewgraph.functions.numbering import batch, numbered
from reviewgraph.operators import reduction as C
from tests import toy


def test_numbers_follow_the_order_without_gaps(spark):
    rows = [(i % 7, f"k{i * 37 % 1000:03}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(6)
    got = numbered(df, [F.col("a").desc(), F.col("b")], "split").orderBy("split").collect()
    assert [r["split"] for r in got] == list(range(1, 1001))
    assert [(r["a"], r["b"]) for r in got] == sorted(((a, b) for a, b, _ in rows),
                                                     key=lambda x: (-x[0], x[1]))


def test_one_key_spreads_over_tasks_and_ties_keep_their_numbers(spark):
    df = spark.range(0, 5000, 1, 5).select(F.lit(1).alias("k"), "id")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # such few rows would become one partition
    try:
        out = numbered(df, [F.col("k"), F.col("id")])
    finally:
        spark.conf.unset(merging)
    assert len(out.inputFiles()) > 1
    assert out.where(F.col("number") != F.col("id") + 1).count() == 0
    tied = numbered(df, [F.col("k")])
    assert sorted(tied.collect()) == sorted(tied.collect())
    assert tied.select("number").distinct().count() == 5000


def test_nulls_first_empty_tables_and_batches(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    out = numbered(df, [F.col("x")])
    assert sorted((r["number"], r["x"]) for r in out.collect()) == [(1, None), (2, "a"), (3, "b")]
    assert [r["x"] for r in batch(out, "number", 2, 2).collect()] == ["a"]
    assert numbered(df.limit(0), [F.col("x")]).collect() == []


def test_the_plan_has_no_single_partition_exchange(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 3)
    plan = numbered(df, [F.col("x"), F.col("id")])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_members_of_a_city_in_batches(spark):
    t = toy.tables(spark)
    places = C.numbered_businesses(t)
    assert toy.rows(places, "split", "id") == [(i, f"R{i}") for i in range(1, 6)]
    people = C.numbered_reviewers(t.with_tables(business=t.business.where("id = 'R3'")))
    assert toy.rows(people, "split", "id") == [(1, "U1"), (2, "U3")]
    some = C.rows_of_batch(t.review, "business_id", places, 3, 4)
    assert toy.rows(some, "id") == [("U1-R3",), ("U2-R4",), ("U3-R3",)]
    assert some.columns == t.review.columns
    parts = C.rows_by_batch(t.review, "business_id", places, 2)
    assert toy.rows(parts.groupBy("batch").count()) == [(0, 6), (1, 3), (2, 1)]
