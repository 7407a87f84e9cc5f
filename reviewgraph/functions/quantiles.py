"""Exact weighted quantiles of many groups of any size at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewgraph.sources.staging import staged

# Bins of a histogram, and the most distinct values that one task puts in order.
BINS = 256
ORDERED = 4096


def _narrowed(values: DataFrame, wide: DataFrame) -> DataFrame:
    """Intervals cut to those of their bins that hold a wanted rank."""
    # Halves, so that the difference of two numbers is one.
    share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    found = values.join(wide, "group").where(F.col("value").between(F.col("low"), F.col("high")))
    bins = (found.groupBy("group", "low", "ranks", "before",
                          F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
            .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("distinct"),
                 F.min("value").alias("new_low"), F.max("value").alias("new_high")))
    until = F.sum("weight").over(Window.partitionBy("group", "low").orderBy("bin"))
    after = bins.withColumn("before", F.col("before") + until - F.col("weight"))
    return after.select(
        "group", F.col("new_low").alias("low"), F.col("new_high").alias("high"), "before",
        "distinct", _inside(F.col("weight")).alias("ranks")).where(F.size("ranks") > 0)


def _inside(weight: Column) -> Column:
    """The wanted ranks that fall between ``before`` and the weight after it."""
    return F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + weight))


def exact_quantiles(rows: DataFrame, value: str, by: Sequence[str], shares: Sequence[float],
                    weight: Column | None = None) -> DataFrame:
    """``by, n, low, high, points``: count, ends and interpolated quantiles of each group.

    A quantile lies between the two values whose ranks enclose ``share * (n - 1)``. Every rank
    is found by histograms between bounds: all intervals of all groups are cut into bins in one
    pass, and the bins that hold a wanted rank are the intervals of the next. At most ``ORDERED``
    distinct values are ever put in order together. Rows without a value, or of no weight, do not
    count; a group without any is left out. ``weight`` is a whole number of rows.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counted = F.lit(1).cast("long") if weight is None else weight.cast("long")
    values = staged(
        rows.select(group.alias("group"), F.col(value).cast("double").alias("value"),
                    counted.alias("weight")).where("value IS NOT NULL AND weight > 0")
        .groupBy("group", "value").agg(F.sum("weight").alias("weight")), "values")
    stats = staged(values.groupBy("group").agg(
        F.sum("weight").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.count(F.lit(1)).alias("distinct")), "stats")
    places = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array_distinct(F.array(*[end(p).cast("long") for p in places
                                       for end in (F.floor, F.ceil)]))
    intervals = stats.select("group", "low", "high", F.lit(0).cast("long").alias("before"),
                             "distinct", ranks.alias("ranks"))
    is_wide = F.col("distinct") > ORDERED
    while not intervals.where(is_wide).isEmpty():
        intervals = staged(intervals.where(~is_wide).unionByName(
            _narrowed(values, intervals.where(is_wide))), "intervals")
    found = values.join(intervals, "group").where(F.col("value").between(F.col("low"),
                                                                         F.col("high")))
    until = F.sum("weight").over(Window.partitionBy("group", "low").orderBy("value"))
    at_rank = (found.withColumn("before", F.col("before") + until - F.col("weight"))
               .select("group", "value", F.explode(_inside(F.col("weight"))).alias("rank")))
    known = at_rank.groupBy("group").agg(F.map_from_entries(F.collect_list(
        F.struct("rank", "value"))).alias("known"))

    def point(place: Column) -> Column:
        low = F.try_element_at("known", F.floor(place).cast("long"))
        high = F.try_element_at("known", F.ceil(place).cast("long"))
        return low + (high - low) * (place - F.floor(place))

    out = stats.join(known, "group").withColumn("points", F.array(*[point(p) for p in places]))
    return out.select(*[F.col(f"group.`{c}`").alias(c) for c in by], "n", "low", "high", "points")
