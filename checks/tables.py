"""Spark side of the views: the review tables of one test-data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import BASE_TABLES, VIEWS
from reviewgraph.sources.staging import staged
from reviewgraph.sources.tables import Tables


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A review's text follows from its business: it is made when read, not written.
REVIEW_TEXT = "repeat('review of ' || business_id || ' ', 30)"


def derive(spark: SparkSession, sf_dir: str, write_reviews: bool = False) -> Tables:
    """The eight review tables, derived lazily from the test tables.

    Users and businesses are made from the reviews. ``write_reviews`` has these written first, for
    operators that read all three, instead of grouping the line items for each of them.
    """
    for name in BASE_TABLES:
        base(spark, sf_dir, name).createOrReplaceTempView(name)
    frames = {}
    for name, sql in VIEWS.items():
        frames[name] = spark.sql(sql)
        if name == "review" and write_reviews:
            frames[name] = staged(frames[name].drop("text"), name).withColumn(
                "text", F.expr(REVIEW_TEXT))
        frames[name].createOrReplaceTempView(name)
    return Tables(one_review_per_pair=True, **frames)


def tables(spark: SparkSession, sf_dir: str, write_reviews: bool = False) -> Tables:
    """The review tables as they are in the folder now, nothing kept from earlier calls."""
    return derive(spark, sf_dir, write_reviews)
