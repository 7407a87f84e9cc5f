"""Caps, ties and hot keys: the cut and sliced plans against a plain calculation."""

import functools
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reviewgraph.functions import ranking
from reviewgraph.operators import recommend as R
from reviewgraph.operators import similarity as S
from reviewgraph.operators import validation as V
from tests import toy


def r2(x):
    return math.floor(x * 100 + 0.5) / 100


@pytest.fixture(scope="module")
def data():
    """30 users and 25 places; place B0 holds a third of the reviews and user P0 nearly all places."""
    rng = random.Random(7)
    pairs = {(f"P{u}", "B0") for u in range(30)} | {("P0", f"B{b}") for b in range(20)}
    while len(pairs) < 100:
        pairs.add((f"P{rng.randrange(30)}", f"B{rng.randrange(25)}"))
    reviews = [(u, b, rng.randint(1, 5), rng.randint(0, 3)) for u, b in sorted(pairs)]
    people = [(f"P{u}", rng.randint(1, 60), rng.randint(0, 5), rng.randint(0, 9),
               rng.randint(2, 10) / 2) for u in range(30)]
    places = [(f"B{b}", str(85000 + b % 4), rng.randint(2, 10) / 2, rng.randint(1, 40))
              for b in range(25)]
    friends = [(f"P{a}", f"P{b}") for a in range(30) for b in range(a % 4)]
    return reviews, people, places, friends


@pytest.fixture(scope="module")
def t(spark, data):
    reviews, people, places, friends = data
    return toy.tables(spark, reviews, people, places, friends)


@pytest.fixture
def small_slices(monkeypatch):
    """Slicing for keys that make more than three rows."""
    sliced = functools.partial(ranking.spread_join, slice_rows=3)
    monkeypatch.setattr(S, "spread_join", sliced)
    monkeypatch.setattr(R, "spread_join", sliced)
    monkeypatch.setattr(V, "spread_join", sliced)


def influence(data, user):
    _, people, _, friends = data
    _, n, votes, fans, avg = next(p for p in people if p[0] == user)
    count = sum(1 for a, _ in friends if a == user)
    parts = [min(math.log(v + 1) / d, 1) for v, d in ((n, 6), (votes, 7), (fans, 5), (count, 6))]
    parts.append(avg / 5)
    whole = parts[1] + parts[3] + parts[0] + parts[2] + parts[4]
    return r2(sum(map(r2, parts))), r2(whole)


def plain_like_users(data, cap, first_order, limit):
    reviews, people, _, _ = data
    info = {p[0]: p for p in people}
    result = {}
    for seed in info:
        first = sorted((s, b) for u, b, s, _ in reviews if u == seed)[:first_order]
        own = {b: s for s, b in first}
        rows = sorted((-info[u][2], u, b, s) for u, b, s, _ in reviews if u != seed and b in own)[:cap]
        scored = []
        for user in {r[1] for r in rows}:
            mine = [(b, s) for _, u, b, s in rows if u == user]
            low = sum(min(s, own[b]) for b, s in mine)
            high = sum(max(s, own[b]) for b, s in mine)
            both = info[user][1] + info[seed][1]
            infl, sel = influence(data, user)[1], influence(data, seed)[0]
            score = r2((r2(min(len(mine) / math.log(both), 1)) if both > 1 else 1.0) + r2(low / high)
                       + r2(min(len(mine) / 5, 1)) + r2(infl / 5) + r2(min(infl, sel) / max(infl, sel)))
            scored.append((score, user, [b for b, _ in mine]))
        for score, user, shared in sorted(scored, reverse=True)[:limit + 1]:
            for b in shared:
                result[(seed, user, b)] = (own[b], len(shared), score)
    return result


def plain_third(data, like, cap, limit):
    """``like``: {(seed, user, item): (.., .., score)} as from plain_like_users."""
    reviews, _, places, _ = data
    stars = {p[0]: p[2] for p in places}
    result = {}
    for seed in {k[0] for k in like}:
        score = {k[1]: v[2] for k, v in like.items() if k[0] == seed}
        known = {k[2] for k in like if k[0] == seed}
        rows = sorted((-stars[b], b, u, s) for u, b, s, _ in reviews
                      if u in score and b not in known)[:cap]
        scored = []
        for item in {r[1] for r in rows}:
            votes = [(u, s, r2(s * score[u])) for _, b, u, s in rows if b == item]
            weight, total = sum(score[v[0]] for v in votes), sum(v[2] for v in votes)
            value = total / weight if len(votes) > 1 else (stars[item] * 5 + total) / (weight + 5)
            scored.append((r2(round(value, 9)), item, votes))
        for value, item, votes in sorted(scored, reverse=True)[:limit + 1]:
            for user, rating, part in votes:
                result[(seed, item, user)] = (rating, part, value)
    return result


def like_rows(like):
    return {(r.seed_id, r.user_id, r.restaurant_id): (r.sel_rating, r.shared_val, r.lmu_score)
            for r in like.collect()}


def third_rows(third):
    return {(r.seed_id, r.restaurant_id, r.user_id): (r.lmu_rating, r.contribution, r.relevancy)
            for r in third.collect()}


@pytest.mark.parametrize("cap, first_order, rows, limit", [
    (12, 3, 8, 4), (None, 3, None, 4), (12, None, 8, 2), (None, None, None, 100)])
def test_like_users_and_recommendations_under_any_caps(data, t, small_slices, cap, first_order,
                                                       rows, limit):
    like = S.like_users(t, limit=limit, first_order=first_order, candidate_rows=cap)
    want = plain_like_users(data, cap, first_order, limit)
    assert like_rows(like) == want
    third = R.recommended_restaurants(t, like, limit=2, considered_rows=rows,
                                      first_order=first_order)
    assert third_rows(third) == plain_third(data, want, cap=rows, limit=2)


def test_limits_are_inclusive_or_not(t):
    def most(rows):
        return rows.groupBy("seed_id").agg(F.countDistinct("user_id").alias("n")).agg(
            F.max("n")).first()[0]

    assert most(S.like_users(t, limit=4)) == 5
    assert most(S.like_users(t, limit=4, inclusive=False)) == 4
    ranks = S.like_users(t, limit=4).select("seed_id", "user_id", "position").distinct()
    assert ranks.count() == ranks.select("seed_id", "position").distinct().count()


def test_highest_first_order(spark):
    t = toy.tables(spark)
    low = S.like_users(t, toy.seeds(spark, "U1"), first_order=1)
    high = S.like_users(t, toy.seeds(spark, "U1"), first_order=1, first_order_by="highest")
    assert {r.restaurant_id for r in low.collect()} == {"R2"}
    assert {r.restaurant_id for r in high.collect()} == {"R3"}
    with pytest.raises(ValueError):
        S.like_users(t, first_order_by="best")


def test_excluding_all_reviewed(data, t, small_slices):
    reviewed = {(u, b) for u, b, *_ in data[0]}
    like = S.like_users(t, limit=4, first_order=2)
    some = R.recommended_restaurants(t, like, first_order=2)
    new = R.recommended_restaurants(t, like, exclude="all_reviewed")
    assert any((r.seed_id, r.restaurant_id) in reviewed for r in some.collect())
    assert not any((r.seed_id, r.restaurant_id) in reviewed for r in new.collect())
    places = S.like_restaurants(t, limit=4, first_order=2)
    people = R.customer_prospects(t, places, exclude="all_reviewed")
    assert people.count() and not any(
        (r.user_id, r.seed_id) in reviewed for r in people.collect())


def test_few_seeds_give_the_same(spark, t, small_slices):
    caps = {"limit": 4, "first_order": 3, "candidate_rows": 9}
    everyone = S.like_restaurants(t, **caps)
    some = S.like_restaurants(t, toy.seeds(spark, "B0", "B3"), **caps)
    assert toy.rows(everyone.where("seed_id in ('B0', 'B3')")) == toy.rows(some)
    caps = {"limit": 3, "first_order": 3, "considered_rows": 7}
    all_p = R.customer_prospects(t, everyone, **caps)
    some_p = R.customer_prospects(t, some, few=True, **caps)
    assert toy.rows(all_p.where("seed_id in ('B0', 'B3')")) == toy.rows(some_p)


def test_pairs_of_look_alikes_at_all_common_restaurants(data, t, small_slices):
    like = S.like_users(t, limit=4, first_order=2)
    stars = {(u, b): s for u, b, s, _ in data[0]}
    want = set()
    for one, two in {tuple(sorted((r.seed_id, r.user_id))) for r in like.collect()}:
        for b in {b for u, b in stars if u == one} & {b for u, b in stars if u == two}:
            x, y = sorted((stars[one, b], stars[two, b]))
            want.add((f"{one}+++{two}", b, round(x / y, 4)))
    got = [(r.user_pair, r.rest_id, r.rating_match) for r in V.user_pairs(t, like).collect()]
    assert set(got) == want and len(got) == len(want)


def test_top_k_of_any_size_is_exact(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 11) AS key", "id",
                                      "pmod(id * 7919, 1009) AS weight")
    order = [F.desc("weight"), F.asc("id")]
    for k in (40, 1500):
        want = {key: sorted(own, key=lambda r: (-r.weight, r.id))[:k]
                for key, own in _by_key(df.collect()).items()}
        got = _by_key(ranking.top_k(df, ["key"], order, k).collect())
        assert {x: sorted(y) for x, y in got.items()} == {x: sorted(y) for x, y in want.items()}
    assert ranking.top_k(df, ["key"], order, None).count() == 5000
    assert int(spark.conf.get(ranking.GROUP_LIMIT)) >= 1500


def _by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r.key, []).append(r)
    return out


@pytest.mark.parametrize("per_key", [None, 2])
def test_spread_join_equals_a_plain_join(spark, per_key):
    many = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 40)) AS key", "id")
    bounded = spark.sql("""SELECT key, x FROM (SELECT explode(array_append(transform(
        sequence(0, 39), i -> concat('k', i)), 'hot')) AS key) LATERAL VIEW explode(array(1, 2)) AS x""")
    joined = ranking.spread_join(many, bounded, "key", spread="id", per_key=per_key, slice_rows=100)
    assert toy.rows(joined.select("key", "id", "x")) == toy.rows(
        many.join(bounded, "key").select("key", "id", "x"))


def test_a_hot_key_makes_bounded_rows_per_task(spark):
    """A third of the rows share a key; no task makes more than a few slices' rows."""
    many = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS key", "id")
    matched = spark.range(50).selectExpr("'hot' AS key", "id AS x")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
                "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = ranking.spread_join(many, matched, "key", spread="id", slice_rows=2_000)
        made = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(made) == 150_000 and max(made) <= 15_000


def test_dangling_reviews_do_not_count(spark):
    ghosts = [("G", "R1", 5, 0), ("G", "R2", 5, 0), ("U0", "LOST", 1, 0), ("U1", "LOST", 1, 0)]
    t, clean = toy.tables(spark, toy.REVIEWS + ghosts), toy.tables(spark)
    for one in (False, True):
        t = replace(t, one_review_per_pair=one)
        for operator in (S.like_users, S.like_restaurants):
            assert toy.rows(operator(t)) == toy.rows(operator(clean))


def test_one_review_per_pair_keeps_the_latest(spark):
    t = toy.tables(spark)
    again = t.review.where("id = 'U0-R1'").selectExpr(
        "'U0-R1-b' AS id", "1L AS stars", "timestamp'2019-01-01' AS date", "text", "9L AS useful",
        "funny", "cool", "business_id", "user_id")
    doubled = t.with_tables(review=t.review.unionByName(again))
    assert doubled.review.count() == 11
    got = toy.rows(doubled.ratings().where("user_id = 'U0'"))
    assert got == [("U0", "R1", 1, 9), ("U0", "R2", 3, 2)]


def test_seed_without_reviews_has_no_result(spark):
    t = toy.tables(spark, people=[*toy.USERS, ("U9", 0, 0, 0, 0.0)])
    assert S.like_users(t, toy.seeds(spark, "U9")).count() == 0


def test_counts_of_one_do_not_divide_by_zero(spark):
    places = [("R1", "85001", 4.0, 1), ("R2", "85001", 3.5, 1)]
    t = toy.tables(spark, [("U0", "R1", 5, 0), ("U0", "R2", 3, 2)], places=places)
    got = S.like_restaurants(t, toy.seeds(spark, "R1")).collect()
    assert [(r.restaurant_id, r.review_sim_score, r.review_sim_val) for r in got] == [
        ("R2", 1.0, "1 / 1")]


def test_pairs_of_users_whose_ratings_are_in_parts(data, t, monkeypatch):
    """Lists of very many ratings are dealt to parts, of few against many too; nothing is lost."""
    like = S.like_users(t, limit=4, first_order=2)
    whole = toy.rows(V.user_pairs(t, like))
    monkeypatch.setattr(V, "PART_RATINGS", 3)
    monkeypatch.setattr(V, "SLICE_LISTS", 4)
    parts = {r.user_id: r.parts for r in V._parts(t).collect()}
    assert len(set(parts.values())) > 1
    assert toy.rows(V.user_pairs(t, like)) == whole and whole


def test_ratings_of_pairs_move_as_lists(t):
    """No exchange carries a row for each rating of each pair: they move by user and part."""
    plan = V.user_pairs(t, S.like_users(t, limit=4, first_order=2))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(long" in text and "hashpartitioning(two" not in text
