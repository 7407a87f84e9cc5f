"""Tables kept for later: folded names, daily sums; checks and comparisons in one pass."""

import math
import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from reviewgraph.operators import momentum as M
from reviewgraph.operators import reduction as C
from reviewgraph.operators import validation as V
from reviewgraph.operators.search import after_prefix, folded_names, search, search_folded
from reviewgraph.sources.staging import staged
from tests import toy

NAMES = ["Ärger", "ärzte", "ARzt", "Zoë", "zoo", "ZOO 2", "%odd", "_odd", "中文", "中国", "red",
         "Red Lion", "REDS", "re", "", "\U0010ffff\U0010ffff", "\ud7ffx", "\ue000", None]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_prefix_is_a_range_of_the_sorted_names(spark):
    places = spark.createDataFrame([(str(i), n, "here" if i % 5 else None) for i, n in enumerate(
        NAMES)], "id string, name string, address string")
    kept = folded_names(places)
    for text in ("red", "RED", "Z", "zoo", "ä", "中", "%", "_", "", "nothing", "\ud7ff",
                 "\U0010ffff"):
        assert search_folded(kept, text, 50).collect() == search(places, text, 50).collect(), text
    told = plan(search_folded(kept, "Red"))
    assert "PushedFilters: [IsNotNull(folded), GreaterThanOrEqual(folded,red), LessThan(folded,ree)]" \
        in told


def test_what_follows_a_prefix():
    assert (after_prefix("ab"), after_prefix("a\U0010ffff")) == ("ac", "b")
    assert after_prefix("") is None and after_prefix("\U0010ffff") is None
    assert after_prefix("\ud7ff") == "\ue000"


def test_daily_sums_are_kept_up_through_late_days(spark):
    rng = random.Random(3)
    rows = [(f"R{rng.randrange(4)}" if i % 3 else "R0", rng.choice([1, 2, 5, None]),
             datetime(2020, 1, 1) + timedelta(days=rng.randrange(40), hours=rng.randrange(24)))
            for i in range(400)]
    review = spark.createDataFrame(rows, "business_id string, stars long, date timestamp")
    late = review.where("date < '2020-01-10' AND stars = 5")
    early = review.exceptAll(late)
    parts = [early.where("date < '2020-01-20'"), early.where("date >= '2020-01-20'"), late]
    state = staged(M.daily_sums(review.limit(0)), "momentum")
    for part in parts:
        state = staged(M.merged_sums(state, part), "momentum")
    assert toy.rows(M.momentum_of(state).fillna(-1)) == toy.rows(M.momentum(review).fillna(-1))
    one = M.momentum_of(state, spark.createDataFrame([("R2",)], "business_id string"))
    assert toy.rows(one.fillna(-1)) == toy.rows(
        M.momentum(review).where("business_id = 'R2'").fillna(-1))


def test_orphans_of_all_keys_meet_in_one_exchange(spark):
    t = toy.tables(spark)
    lost = toy.review(spark, [("GHOST", "R1", 3, 0)] * 50 + [("U0", "NOWHERE", 1, 0)])
    out = C.key_orphans(t.with_tables(review=t.review.unionByName(lost)))
    told = plan(out)
    got = {r["foreign_key"]: (r["orphan_keys"], r["orphan_rows"]) for r in out.collect()}
    assert got["review.user_id"] == (1, 50) and got["review.business_id"] == (1, 1)
    assert got["friend.user_id"] == (0, 0) and len(got) == 6
    assert told.split("== Physical Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_differences_of_any_number_of_labels(spark):
    rng = random.Random(1)
    groups = {k: [rng.choice([0.0, 0.5, 1.0, k / 4]) for _ in range(5 + 3 * k)] for k in range(5)}
    rows = [(g, k, v) for g in ("x", "y") for k, vs in groups.items() for v in vs]
    got = V.pairwise_differences(spark.createDataFrame(rows, "g string, k int, v double"),
                                 by=("g",), label="k", value="v").where("g = 'x'").collect()
    means = {k: sum(v) / len(v) for k, v in groups.items()}
    n = sum(map(len, groups.values()))
    within = sum((x - means[k]) ** 2 for k, v in groups.items() for x in v) / (n - len(groups))
    assert [(r["label1"], r["label2"]) for r in sorted(got)] == list(combinations(range(5), 2))
    for r in got:
        a, b = r["label1"], r["label2"]
        se = math.sqrt(within / 2 * (1 / len(groups[a]) + 1 / len(groups[b])))
        assert r["difference"] == pytest.approx(means[a] - means[b], abs=1e-6)
        assert r["se"] == pytest.approx(se, abs=1e-6)
        assert r["q"] == pytest.approx(abs(means[a] - means[b]) / se, abs=1e-5)


def test_a_pair_with_many_shared_restaurants_is_crossed_in_slices(spark):
    rows = [("a+++b", f"n{i}", f"r{i:03}", i / 100) for i in range(60)] + [("c+++d", "n", "r", 1.0)]
    pairs = spark.createDataFrame(
        rows, "user_pair string, restaurant string, rest_id string, rating_match double")
    got = V.pair_cross(pairs).where(F.col("match1") < F.col("match2"))
    assert got.count() == 60 * 59 // 2 and V.pair_cross(pairs).count() == 60 * 59 // 2
