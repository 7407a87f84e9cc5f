"""Do two users who agree on one restaurant agree on the next, and do look-alikes agree more?

The pairs of users behind these statistics are never listed: a popular restaurant has far too
many. A pair's agreement depends only on the two ratings, so pairs are counted per combination
of ratings. Each row of a class table stands for ``pairs`` user pairs and the statistics take
that number as a weight; they equal the ones over the listed pairs. Pairs are listed one by one
only for look-alikes, of which a user has a fixed number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.functions.numbering import numbered_ids
from reviewgraph.functions.quantiles import exact_quantiles
from reviewgraph.functions.ranking import narrow_types, side_by_side, spread_join, top_k
from reviewgraph.sources.staging import staged
from reviewgraph.sources.tables import Tables

COMPARED_RESTAURANTS = 10
PAIR_SEPARATOR = "+++"
QUARTILES = (0.25, 0.5, 0.75)
# About how many ratings of a user travel as one row, and how many such rows make a slice of a join.
PART_RATINGS = 1024
SLICE_LISTS = 50_000


def rating_match(a: Column, b: Column) -> Column:
    """Smaller rating over larger rating, four decimals."""
    return F.round(F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b)), 4)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(PAIR_SEPARATOR), F.greatest(a, b))


def rating_matrix(t: Tables, seeds: DataFrame, k: int = COMPARED_RESTAURANTS) -> DataFrame:
    """Ratings of a seed restaurant's reviewers at the ``k`` restaurants they review most."""
    ratings = t.ratings().select("user_id", F.col("business_id").alias("rest_id"),
                                 F.col("stars").alias("rating"))
    reviewers = (ratings.select(F.col("rest_id").alias("seed_id"), "user_id")
                 .join(seeds.select("seed_id").distinct(), "seed_id", "left_semi"))
    theirs = ratings.join(reviewers, "user_id")
    counted = theirs.groupBy("seed_id", "rest_id").agg(F.count(F.lit(1)).alias("reviewers"))
    chosen = top_k(counted, ["seed_id"], [F.desc("reviewers"), F.asc("rest_id")], k).select("seed_id", "rest_id")
    names = t.business.select(F.col("id").alias("rest_id"), F.col("name").alias("restaurant"))
    return (theirs.join(chosen, ["seed_id", "rest_id"]).join(names, "rest_id")
            .select("seed_id", "restaurant", "rest_id", "user_id", "rating"))


def _class_pairs(histogram: DataFrame, keys: list[str], rating: list[str]) -> DataFrame:
    """Pairs of rating classes with the number of user pairs behind each.

    ``histogram`` counts users (``n``) per key and rating class; the few classes of a key are
    gathered in one array.
    """
    classes = histogram.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*rating, "n"))).alias("classes"))
    first = classes.select("*", F.posexplode("classes").alias("i", "a"))
    both = first.select(*keys, "i", "a", F.posexplode("classes").alias("j", "b")).where("i <= j")
    pairs = F.when(F.col("i") == F.col("j"),
                   F.floor(F.col("a.n") * (F.col("a.n") - 1) / 2)).otherwise(
        F.col("a.n") * F.col("b.n")).cast("bigint")
    return both.withColumn("pairs", pairs).where("pairs > 0")


def pair_classes(matrix: DataFrame) -> DataFrame:
    """Per restaurant, how many user pairs agree to which degree.

    Columns ``seed_id, rest_id, restaurant, rating_match, pairs``.
    """
    keys = ["seed_id", "rest_id", "restaurant"]
    histogram = matrix.groupBy(*keys, "rating").agg(F.count(F.lit(1)).alias("n"))
    match = rating_match(F.col("a.rating"), F.col("b.rating"))
    return (_class_pairs(histogram, keys, ["rating"])
            .groupBy(*keys, match.alias("rating_match")).agg(F.sum("pairs").alias("pairs")))


def pair_cross_classes(matrix: DataFrame) -> DataFrame:
    """Per two restaurants, how many user pairs that rated both agree to which degrees.

    Columns ``seed_id, rest_id1, restaurant1, match1, rest_id2, restaurant2, match2, pairs``.
    A user has at most ``k`` rows in the matrix, so the restaurant pairs per user are few.
    """
    mine = F.array_sort(F.collect_list(F.struct("rest_id", "restaurant", "rating")))
    per_user = matrix.groupBy("seed_id", "user_id").agg(mine.alias("rated"))
    first = per_user.select("seed_id", "rated", F.posexplode("rated").alias("i", "x"))
    two = (first.select("seed_id", "i", "x", F.posexplode("rated").alias("j", "y"))
           .where("i < j")
           .select("seed_id", F.col("x.rest_id").alias("rest_id1"),
                   F.col("x.restaurant").alias("restaurant1"),
                   F.col("y.rest_id").alias("rest_id2"),
                   F.col("y.restaurant").alias("restaurant2"),
                   F.col("x.rating").alias("rating1"), F.col("y.rating").alias("rating2")))
    keys = ["seed_id", "rest_id1", "restaurant1", "rest_id2", "restaurant2"]
    histogram = two.groupBy(*keys, "rating1", "rating2").agg(F.count(F.lit(1)).alias("n"))
    match1 = rating_match(F.col("a.rating1"), F.col("b.rating1"))
    match2 = rating_match(F.col("a.rating2"), F.col("b.rating2"))
    return (_class_pairs(histogram, keys, ["rating1", "rating2"])
            .groupBy(*keys, match1.alias("match1"), match2.alias("match2"))
            .agg(F.sum("pairs").alias("pairs")))


def _parts(t: Tables) -> DataFrame:
    """``user_id, parts`` of users whose ratings are more than one row can hold: a power of two."""
    n = t.ratings().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / PART_RATINGS))).cast("int")
    return F.broadcast(n.where(F.col("n") > PART_RATINGS).select("user_id", parts.alias("parts")))


def _part(place: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(place.cast("bigint")), parts).cast("int")


def user_pairs(t: Tables, like_users: DataFrame) -> DataFrame:
    """Every pair of look-alikes at every restaurant that both have rated.

    Columns ``user_pair, restaurant, rest_id, rating_match``, one row per pair and restaurant. A
    user has a bounded number of look-alikes, so rows grow with the ratings.

    A user's ratings move as one row of numbers, those of users with very many in parts dealt by
    restaurant. The one in fewer parts goes to the other, entry by entry if that has more of them:
    what moves follows the shorter list. There is at most one such user for each ``PART_RATINGS``
    ratings, so these few are broadcast.
    """
    names = t.business.select(F.col("id").alias("rest_id"), F.col("name").alias("restaurant"))
    numbers, cut, one_part = numbered_ids(names, "rest_id", "place"), _parts(t), F.lit(1)
    rated = t.ratings().select("user_id", F.col("business_id").alias("rest_id"),
                               F.col("stars").alias("rating")).join(numbers, "rest_id")
    lists = staged(rated.join(cut, "user_id", "left").groupBy(
        "user_id", _part(F.col("place"), F.coalesce("parts", one_part)).alias("part")).agg(
        F.collect_list(F.struct("place", "rating")).alias("_list")), "lists")
    moved = side_by_side(lists, narrow_types(lists))
    both = like_users.select(F.least("seed_id", "user_id").alias("one"),
                             F.greatest("seed_id", "user_id").alias("two")).distinct()
    for n in ("one", "two"):
        both = both.join(cut.select(F.col("user_id").alias(n), F.col("parts").alias(f"parts_{n}")),
                         n, "left").withColumn(f"parts_{n}", F.coalesce(f"parts_{n}", one_part))
    swap = F.col("parts_one") > F.col("parts_two")
    pairs = staged(both.select(
        F.when(swap, F.col("two")).otherwise(F.col("one")).alias("short"),
        F.when(swap, F.col("one")).otherwise(F.col("two")).alias("long"),
        F.greatest("parts_one", "parts_two").alias("parts"),
        (F.col("parts_one") != F.col("parts_two")).alias("finer")), "alike")
    short = spread_join(pairs, moved.withColumnRenamed("user_id", "short"), "short", spread="long",
                        slice_rows=SLICE_LISTS)
    places, ratings = F.col("_arrays.place"), F.col("_arrays.rating")
    entries = F.transform(F.arrays_zip(places.alias("place"), ratings.alias("rating")), lambda x: F.struct(
        _part(x["place"], F.col("parts")).alias("part"), F.array(x["place"]).alias("places"),
        F.array(x["rating"]).alias("ratings")))
    whole = F.array(F.struct("part", places.alias("places"), ratings.alias("ratings")))
    rows = short.select("short", "long", F.inline(F.when(F.col("finer"), entries).otherwise(whole)))
    met = spread_join(rows, moved.withColumnRenamed("user_id", "long"), "long", spread="short",
                      per_key=1, slice_rows=SLICE_LISTS, also=["part"], counted=pairs)
    met = met.withColumn("shared", F.array_intersect("places", places)).where(F.size("shared") > 0)

    def rating(of: Column, at: Column) -> Column:
        return F.get(of, (F.array_position(at, F.col("place")) - 1).cast("int")).cast("bigint")

    return (met.withColumn("place", F.explode("shared"))
            .select(pair_key(F.col("short"), F.col("long")).alias("user_pair"),
                    F.col("place").cast("bigint").alias("place"),
                    rating_match(rating(F.col("ratings"), F.col("places")),
                                 rating(ratings, places)).alias("rating_match"))
            .join(names.join(numbers, "rest_id"), "place")
            .select("user_pair", "restaurant", "rest_id", "rating_match"))


def pair_cross(pairs: DataFrame) -> DataFrame:
    """Two restaurants of one user pair side by side, each combination once.

    The list of combinations is the result itself; for their statistics alone use
    :func:`pair_cross_classes`, which does not list them. A pair that shares very many restaurants
    is joined in slices.
    """
    pairs = staged(pairs, "pairs")

    def side(n: int) -> DataFrame:
        return pairs.select("user_pair", F.col("rest_id").alias(f"rest{n}"),
                            F.col("restaurant").alias(f"restaurant{n}"),
                            F.col("rating_match").alias(f"match{n}"))

    return (spread_join(side(1), side(2), "user_pair", spread="rest1").where("rest1 < rest2")
            .select("user_pair", "restaurant1", "match1", "restaurant2", "match2"))


def pair_long(cross: DataFrame) -> DataFrame:
    """One row per user pair and restaurant: the two sides of the cross table, stacked."""
    return (cross.select("user_pair", F.explode(F.array(
        F.struct(F.col("restaurant1").alias("restaurant"), F.col("match1").alias("match")),
        F.struct(F.col("restaurant2").alias("restaurant"), F.col("match2").alias("match"))))
        .alias("side")).select("user_pair", "side.*").distinct())


def labelled_classes(matrix: DataFrame, like_users: DataFrame) -> DataFrame:
    """Pair counts by agreement and by whether the two users are look-alikes (``lmu`` 1 or 0).

    Look-alike pairs are counted from their list, the others as all pairs less these.
    """
    pairs = like_users.select(F.least("seed_id", "user_id").alias("user1"),
                              F.greatest("seed_id", "user_id").alias("user2")).distinct()
    side = lambda n: matrix.select(
        "seed_id", "rest_id", F.col("user_id").alias(f"user{n}"), F.col("rating").alias(f"rating{n}"))
    alike = (side(1).join(pairs, "user1").join(side(2), ["seed_id", "rest_id", "user2"])
             .groupBy("seed_id", rating_match(F.col("rating1"), F.col("rating2")).alias("match"))
             .agg(F.count(F.lit(1)).alias("alike")))
    every = (pair_classes(matrix).groupBy("seed_id", F.col("rating_match").alias("match"))
             .agg(F.sum("pairs").alias("every")))
    alike_pairs = F.coalesce("alike", F.lit(0).cast("bigint"))
    return (every.join(alike, ["seed_id", "match"], "left")
            .select("seed_id", "match", F.explode(F.array(
                F.struct(F.lit(1).alias("lmu"), alike_pairs.alias("pairs")),
                F.struct(F.lit(0).alias("lmu"), (F.col("every") - alike_pairs).alias("pairs"))))
                .alias("x")).select("seed_id", "match", "x.*").where("pairs > 0"))


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")


def _exact(x: Column) -> Column:
    """Sums over decimals do not depend on their order."""
    return x.cast("decimal(20,8)")


def pair_corr(cross: DataFrame, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and Pearson correlation of ``match1`` and ``match2``."""
    w, x, y = _weight(weight), F.col("match1"), F.col("match2")

    def total(column: Column) -> Column:
        return F.sum(_exact(column)).cast("double")

    sums = cross.groupBy(*by).agg(
        F.sum(w).alias("n"), total(w * x).alias("sx"), total(w * y).alias("sy"),
        total(w * x * x).alias("sxx"), total(w * y * y).alias("syy"),
        total(w * x * y).alias("sxy"))
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx"))
                    * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return sums.select(*by, "n", F.round(F.col("sx") / n, 6).alias("mean1"),
                       F.round(F.col("sy") / n, 6).alias("mean2"),
                       F.round(F.try_divide(cov, spread), 6).alias("corr"))


def pair_means(rows: DataFrame, weight: str | None = None, by: tuple[str, ...] = (),
               label: str = "lmu", value: str = "match") -> DataFrame:
    """Number and mean agreement per label."""
    w = _weight(weight)
    return rows.groupBy(*by, label).agg(
        F.sum(w).alias("n"),
        F.round(F.sum(_exact(w * F.col(value))).cast("double") / F.sum(w), 6).alias("mean"))


def pair_anova(rows: DataFrame, weight: str | None = None, by: tuple[str, ...] = (),
               label: str = "lmu", value: str = "match") -> DataFrame:
    """One-way analysis of variance of the agreement by label.

    Sums of squares between and within the labels, degrees of freedom, F, eta squared and the
    difference between the highest and lowest label mean (the pairwise difference when there
    are two labels).
    """
    w, x = _weight(weight), F.col(value)
    groups = rows.groupBy(*by, label).agg(
        F.sum(w).alias("n"), F.sum(_exact(w * x)).cast("double").alias("s"),
        F.sum(_exact(w * x * x)).cast("double").alias("ss"))
    groups = groups.withColumn("fit", F.col("s") * F.col("s") / F.col("n"))
    total = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.sum("ss").alias("ss"), F.sum("fit").alias("fit"),
        (F.max(F.col("s") / F.col("n")) - F.min(F.col("s") / F.col("n"))).alias("diff"))
    between = F.col("fit") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("ss") - F.col("fit")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return total.select(
        *by, F.round(between, 6).alias("ss_between"), F.round(within, 6).alias("ss_within"),
        df1.alias("df_between"), df2.alias("df_within"),
        F.round(F.try_divide(F.try_divide(between, df1), F.try_divide(within, df2)), 6).alias("f"),
        F.round(F.try_divide(between, between + within), 6).alias("eta_squared"),
        F.round("diff", 6).alias("mean_difference"))


def pairwise_differences(rows: DataFrame, weight: str | None = None, by: tuple[str, ...] = (),
                         label: str = "lmu", value: str = "match") -> DataFrame:
    """Every two labels with the difference of their means, for any number of labels.

    ``difference`` is the mean of ``label1`` less that of ``label2``, ``se`` its standard error
    from the variance within all labels (for labels of unequal size too), ``q`` the studentised
    range statistic.
    """
    w, x = _weight(weight), F.col(value)
    groups = rows.groupBy(*by, label).agg(
        F.sum(w).alias("n"), F.sum(_exact(w * x)).cast("double").alias("s"),
        F.sum(_exact(w * x * x)).cast("double").alias("ss"))
    fit = F.col("s") * F.col("s") / F.col("n")
    # The labels are few; a group's labels meet in one row.
    total = groups.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n", (
            F.col("s") / F.col("n")).alias("mean")))).alias("labels"),
        (F.sum(F.col("ss") - fit) / (F.sum("n") - F.count(F.lit(1)))).alias("within"))
    one = total.select(*by, "within", "labels", F.posexplode("labels").alias("i", "a"))
    two = one.select(*by, "within", "i", "a", F.posexplode("labels").alias("j", "b")).where("i < j")
    difference = F.col("a.mean") - F.col("b.mean")
    se = F.sqrt(F.col("within") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    return two.select(*by, F.col("a.label").alias("label1"), F.col("b.label").alias("label2"),
                      F.col("a.n").alias("n1"), F.col("b.n").alias("n2"),
                      F.round(difference, 6).alias("difference"), F.round(se, 6).alias("se"),
                      F.round(F.try_divide(F.abs(difference), se), 6).alias("q"))


def quartiles(rows: DataFrame, value: str, by: tuple[str, ...] = ("lmu",),
              weight: str | None = None) -> DataFrame:
    """Minimum, quartiles and maximum: the numbers behind a box plot."""
    stats = exact_quantiles(rows, value, by, QUARTILES, _weight(weight))
    return stats.select(*by, "n", F.round("low", 6).alias("low"),
                        *[F.round(F.col("points")[i], 6).alias(name)
                          for i, name in enumerate(("q1", "median", "q3"))],
                        F.round("high", 6).alias("high"))
