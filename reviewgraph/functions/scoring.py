"""Score expressions. All of them are built-in Spark columns, none is a UDF.

Every published score is a non-negative number with two decimals. Sums of such scores are
taken over whole hundredths so that the order in which partial sums arrive cannot change a
result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisors of the capped logarithms and ceilings of the counted scores.
REVIEWS_DIVISOR = 6
VOTES_DIVISOR = 7
FANS_DIVISOR = 5
FRIENDS_DIVISOR = 6
MAX_STARS = 5
SHARED_RESTAURANTS_FULL = 5
SHARED_CUSTOMERS_FULL = 10
CUSTOMER_OVERLAP_DIVISOR = 5
SINGLE_VOTE_WEIGHT = 5


def r2(x: Column) -> Column:
    """Round half up to two decimals (inputs are never negative)."""
    return F.floor(x * 100 + 0.5) / 100


def exact_sum(x: Column) -> Column:
    """Sum of two-decimal scores, independent of their order."""
    return F.sum(F.floor(x * 100 + 0.5)) / 100


def capped_log(count: Column, divisor: int) -> Column:
    return F.least(F.ln(count + 1) / divisor, F.lit(1.0))


def influence_parts(reviews: Column, votes: Column, fans: Column, friends: Column,
                    avg_rating: Column) -> dict[str, Column]:
    """The five influence sub-scores, unrounded."""
    return {
        "total_reviews_score": capped_log(reviews, REVIEWS_DIVISOR),
        "review_likes_score": capped_log(votes, VOTES_DIVISOR),
        "fans_score": capped_log(fans, FANS_DIVISOR),
        "friends_score": capped_log(friends, FRIENDS_DIVISOR),
        "avg_rating_score": avg_rating / MAX_STARS,
    }


def influence_of_profile(parts: dict[str, Column]) -> Column:
    """Influence shown on a profile: the sub-scores are rounded before they are added."""
    total = None
    for part in parts.values():
        total = r2(part) if total is None else total + r2(part)
    return r2(total)


def influence_of_candidate(parts: dict[str, Column]) -> Column:
    """Influence used to score a look-alike: rounded once, after adding."""
    return r2(parts["review_likes_score"] + parts["friends_score"] + parts["total_reviews_score"]
              + parts["fans_score"] + parts["avg_rating_score"])


def ratio_score(part: Column, whole: Column) -> Column:
    """``part / whole`` with two decimals; two zeros count as equal."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(r2(F.try_divide(part, whole)))


def share_score(shared: Column, full: int) -> Column:
    return r2(F.least(shared / full, F.lit(1.0)))


def overlap_score(shared: Column, combined: Column, divisor: int = 1) -> Column:
    """Shared items against the log of both sides' review counts.

    A combined count below two has no usable logarithm; it then counts as full overlap.
    """
    log = F.ln(F.greatest(combined, F.lit(1))) * divisor
    return F.when(log <= 0, F.lit(1.0)).otherwise(
        r2(F.least(F.try_divide(shared, log), F.lit(1.0))))


def log_ratio_score(a: Column, b: Column) -> Column:
    """Logarithm of the smaller count over that of the larger; two counts of one are equal."""
    low = F.ln(F.greatest(F.least(a, b), F.lit(1)))
    high = F.ln(F.greatest(F.greatest(a, b), F.lit(1)))
    return F.when(high == 0, F.lit(1.0)).otherwise(r2(F.try_divide(low, high)))


def label(a: Column, b: Column) -> Column:
    """``"a / b"`` as shown next to a score."""
    return F.concat_ws(" / ", a.cast("string"), b.cast("string"))


def whole(x: Column) -> Column:
    return x.cast("bigint")


def least_of(a: Column, b: Column) -> Column:
    """Smaller value, NULL when either side is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greatest_of(a: Column, b: Column) -> Column:
    """Larger value, NULL when either side is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
