"""Running numbers over whole tables, made without bringing the rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.sources.staging import staged

# Fixed value: the bits that Spark's increasing ids have for the place within a partition.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "number",
             drop: Sequence[str] = ()) -> DataFrame:
    """All rows with their place in the order, 1 to the number of rows, without gaps.

    Rows are dealt out and sorted by range, so that equal keys can spread over tasks, and written
    once with their place within the range. The sizes of the ranges, one number for each
    partition, add up to the ranges' offsets. Rows equal in the order are numbered as they come;
    their numbers stay, as the rows are read from what was written. Columns to ``drop`` are there
    for the order only and are not written.
    """
    spark = df.sparkSession
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop)
                  .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", PLACE_BITS).cast("int")
    offsets, total = [(-1, 0)], 0
    for own in sorted(rows.groupBy(part.alias("part")).count().collect()):
        offsets.append((own["part"], total))
        total += own["count"]
    ranges = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (rows.withColumn("_part", part).join(ranges, "_part")
            .withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_at"))


def numbered_ids(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """``key, name``: every distinct id with its place in their order.

    Numbers compare as their ids do and take less room in rows that move often.
    """
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    return numbered(ids, [F.asc(key)], name)


def batch(df: DataFrame, number: str, first: int, last: int) -> DataFrame:
    """The rows whose running number lies between ``first`` and ``last``, both included."""
    return df.where(F.col(number).between(first, last))
