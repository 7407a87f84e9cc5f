"""Reducing the data to one category or city, cleaning it, and checking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.functions.numbering import batch, numbered
from reviewgraph.sources.schemas import KEYS, REFERENCES
from reviewgraph.sources.tables import Tables

RESTAURANTS = "Restaurants"
CITY = "Phoenix"

# Spellings and districts of the city. A spelling always counts; a district only
# where the zip code lies strictly between the two bounds.
CITY_SPELLINGS = ("Pheonix", "Pheonix AZ", "Phoenix Valley", "Phx")
CITY_DISTRICTS = ("Ahwatukee", "Anthem", "Central City", "Central City Village",
                  "South Mountain")
ZIP_AFTER, ZIP_BEFORE = 85000, 85087

# Tables whose rows belong to a business.
BUSINESS_CHILDREN = ("attribute", "category", "checkin", "hours", "photo", "review", "tip")
# Tables that remain after the reduction to a city.
CITY_TABLES = ("attribute", "business", "category", "friend", "review", "users")


def _only(df: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``column`` is (or, with ``left_anti``, is not) among the ids, columns as before."""
    wanted = ids.select(F.col(ids.columns[0]).alias(column))
    return df.join(wanted, column, how).select(*df.columns)


def with_category(t: Tables, category: str = RESTAURANTS) -> DataFrame:
    """Ids of the businesses that carry the category."""
    return t.category.where(F.col("category") == category).select("business_id").distinct()


def reduce_to_category(t: Tables, category: str = RESTAURANTS) -> Tables:
    """Keep the businesses of one category and the rows that belong to them."""
    keep = with_category(t, category)
    frames = {name: _only(df, "business_id", keep)
              for name, df in t.present().items() if name in BUSINESS_CHILDREN}
    return t.with_tables(business=_only(t.business, "id", keep), **frames)


def normalise_city(business: DataFrame, city: str = CITY, spellings=CITY_SPELLINGS,
                   districts=CITY_DISTRICTS, after: int = ZIP_AFTER,
                   before: int = ZIP_BEFORE) -> DataFrame:
    """Give misspelt and district names the city's name."""
    zip_code = F.expr("try_cast(postal_code AS int)")
    inside = (zip_code > after) & (zip_code < before)
    means_city = F.col("city").isin(*spellings) | (F.col("city").isin(*districts) & inside)
    return business.withColumn("city", F.when(means_city, F.lit(city)).otherwise(F.col("city")))


def reduce_to_city(t: Tables, city: str = CITY) -> Tables:
    """Keep one city: its businesses, their rows, the reviewers, and friendships among these.

    ``business.city`` is expected to be normalised. Five tables are dropped.
    """
    business = t.business.where(F.col("city") == city)
    ids = business.select("id")
    review = _only(t.review, "business_id", ids)
    reviewers = review.select("user_id").distinct()
    friend = _only(_only(t.friend, "user_id", reviewers), "friend_id", reviewers)
    return Tables(
        review=review, business=business, users=_only(t.users, "id", reviewers), friend=friend,
        category=_only(t.category, "business_id", ids),
        attribute=_only(t.attribute, "business_id", ids),
        one_review_per_pair=t.one_review_per_pair)


def inactive_users(t: Tables) -> DataFrame:
    """Users with neither a review nor a tip."""
    active = t.review.select("user_id").unionByName(t.tip.select("user_id")).distinct()
    return (t.users.select(F.col("id").alias("user_id"))
            .join(active, "user_id", "left_anti"))


def drop_inactive(t: Tables) -> Tables:
    """Remove inactive users, their elite years and every friendship they are part of."""
    gone = inactive_users(t)
    friend = _only(_only(t.friend, "user_id", gone, "left_anti"), "friend_id", gone, "left_anti")
    return t.with_tables(users=_only(t.users, "id", gone, "left_anti"),
                         elite_years=_only(t.elite_years, "user_id", gone, "left_anti"),
                         friend=friend)


def table_counts(before: Tables, after: Tables | None = None) -> DataFrame:
    """Rows per table, before and after a reduction; a dropped table has no count after."""
    def counts(t: Tables, name: str) -> DataFrame:
        union = None
        for table, df in sorted(t.present().items()):
            one = df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(table).alias("table_name"),
                                                               name)
            union = one if union is None else union.unionByName(one)
        return union

    left = counts(before, "rows_before")
    if after is None:
        return left
    return left.join(counts(after, "rows_after"), "table_name", "left")


def key_duplicates(t: Tables) -> DataFrame:
    """Per table, how many primary-key values occur more than once and how many rows hold them."""
    union = None
    for table, df in sorted(t.present().items()):
        repeated = df.groupBy(*KEYS[table]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        one = repeated.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                           F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows")).select(
            F.lit(table).alias("table_name"), "duplicate_keys", "duplicate_rows")
        union = one if union is None else union.unionByName(one)
    return union


def key_orphans(t: Tables) -> DataFrame:
    """Per foreign key, how many values and rows point at nothing.

    Keys of all parents and children meet in one exchange, counted before they move: a value that
    fills much of a table is one row there.
    """
    frames = t.present()
    checked = [(child, column, parent, key) for (child, column), (parent, key)
               in sorted(REFERENCES.items()) if child in frames and parent in frames]

    def keys(table: str, column: str, parent: str, name: str) -> DataFrame:
        return frames[table].select(F.lit(parent).alias("parent"), F.col(column).alias("key"),
                                    F.lit(name).alias("use"))

    tagged = None
    for child, column, parent, _ in checked:
        one = keys(child, column, parent, f"{child}.{column}")
        tagged = one if tagged is None else tagged.unionByName(one)
    if tagged is None:
        return t.review.sparkSession.createDataFrame(
            [], "foreign_key string, orphan_keys long, orphan_rows long")
    for parent, key in sorted({(p, k) for _, _, p, k in checked}):
        tagged = tagged.unionByName(keys(parent, key, parent, ""))
    uses = [f"{child}.{column}" for child, column, _, _ in checked]
    counts = [F.count(F.when(F.col("use") == u, 1)).alias(f"n{i}") for i, u in enumerate(uses)]
    lost = (tagged.where(F.col("key").isNotNull()).groupBy("parent", "key")
            .agg(F.max(F.col("use") == "").alias("there"), *counts).where(~F.col("there")))
    sums = lost.agg(*[f(F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))).alias(f"{name}{i}")
                      for i in range(len(uses)) for f, name in ((F.count, "keys"), (F.sum, "rows"))])
    return sums.select(F.explode(F.array(*[F.struct(
        F.lit(u).alias("foreign_key"), F.col(f"keys{i}").alias("orphan_keys"),
        F.coalesce(f"rows{i}", F.lit(0)).alias("orphan_rows")) for i, u in enumerate(uses)]))
        .alias("x")).select("x.*")


def category_stats(t: Tables) -> DataFrame:
    """Counts that tell restaurants from other food places, and rows per restaurant."""
    # The category labels the counts look at.
    food, nightlife = "Food", ("Bars", "Pubs", "Lounges", "Nightlife")

    def has(*names: str) -> Column:
        return F.max(F.when(F.col("category").isin(*names), 1).otherwise(0))

    per_business = t.category.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("categories"), has(RESTAURANTS).alias("restaurant"),
        has(food).alias("food"), has(*nightlife).alias("nightlife"))
    reviews = t.review.groupBy("business_id").agg(F.count(F.lit(1)).alias("reviews"))
    rows = per_business.join(reviews, "business_id", "left")
    restaurant = F.col("restaurant") == 1
    food_only = (F.col("food") == 1) & (F.col("restaurant") == 0)

    def over(column: str):
        return F.when(restaurant, F.col(column))

    stats = rows.agg(
        F.count(F.when(restaurant, 1)).alias("restaurants"),
        F.coalesce(F.sum(F.when(food_only, F.col("categories"))), F.lit(0)).alias(
            "food_not_restaurant_rows"),
        F.count(F.when(food_only & (F.col("nightlife") == 1), 1)).alias(
            "food_and_nightlife_not_restaurant"),
        F.max(over("categories")).alias("max_categories"),
        F.sum(over("categories")).alias("restaurant_categories"),
        F.max(over("reviews")).alias("max_reviews"),
        F.sum(over("reviews")).alias("restaurant_reviews"))
    mean = lambda name: F.round(F.try_divide(F.col(name), F.col("restaurants")), 4)
    return stats.withColumn("mean_categories", mean("restaurant_categories")).withColumn(
        "mean_reviews", mean("restaurant_reviews"))


def rows_per_restaurant(t: Tables) -> DataFrame:
    """Number of categories and of reviews of every restaurant."""
    keep = with_category(t)
    categories = (t.category.join(keep, "business_id", "left_semi").groupBy("business_id")
                  .agg(F.count(F.lit(1)).alias("categories")))
    reviews = (t.review.join(keep, "business_id", "left_semi").groupBy("business_id")
               .agg(F.count(F.lit(1)).alias("reviews")))
    return categories.join(reviews, "business_id", "left").withColumn(
        "reviews", F.coalesce("reviews", F.lit(0).cast("bigint")))


def city_zip_pairs(business: DataFrame) -> DataFrame:
    return business.select("city", "postal_code").distinct()


def numbered_businesses(t: Tables, city: str = CITY) -> DataFrame:
    """``split, id``: the city's businesses with running numbers from 1, by id."""
    return numbered(t.business.where(F.col("city") == city).select("id"), [F.col("id")], "split")


def numbered_reviewers(t: Tables, city: str = CITY) -> DataFrame:
    """``split, id``: everybody who reviewed a business of the city, with running numbers by id."""
    places = t.business.where(F.col("city") == city).select("id")
    people = _only(t.review.select("user_id", "business_id"), "business_id", places)
    return numbered(people.select(F.col("user_id").alias("id")).distinct(), [F.col("id")], "split")


def rows_of_batch(df: DataFrame, key: str, members: DataFrame, first: int, last: int) -> DataFrame:
    """Rows whose ``key`` is an id numbered (``split, id``) between ``first`` and ``last``."""
    return _only(df, key, batch(members, "split", first, last).select("id"))


def rows_by_batch(df: DataFrame, key: str, members: DataFrame, size: int) -> DataFrame:
    """``batch`` (from 0) and the rows of every batch of ``size`` running numbers."""
    numbers = members.select(F.col("id").alias(key),
                             F.floor((F.col("split") - 1) / size).alias("batch"))
    return df.join(numbers, key).select("batch", *df.columns)
