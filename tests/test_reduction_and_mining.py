import pytest
from pyspark.sql import functions as F

from reviewgraph.operators import mining as M
from reviewgraph.operators import reduction as C
from reviewgraph.sources import schemas
from reviewgraph.sources.tables import append_rows, empty_like, load_tables, save_tables
from tests import toy


@pytest.fixture(scope="module")
def t(spark):
    tips = [("R4", "U9", "go", toy.DAY, 1)]
    years = [("U0", "2016"), ("U8", "2017")]
    people = [*toy.USERS, ("U8", 0, 0, 0, 0.0), ("U9", 0, 0, 0, 0.0)]
    friends = [*toy.FRIENDS, ("U8", "U0"), ("U0", "U8"), ("U1", "U9")]
    base = toy.tables(spark, people=people, friends=friends)
    return base.with_tables(tip=spark.createDataFrame(tips, schemas.TIP),
                            elite_years=spark.createDataFrame(years, schemas.ELITE_YEARS),
                            checkin=spark.createDataFrame([("R1", "Fri-9", 2), ("R4", "Sat-1", 1)],
                                                          schemas.CHECKIN),
                            hours=spark.createDataFrame([("Mon 9-17", "R1"), ("Mon 9-17", "R3")],
                                                        schemas.HOURS),
                            photo=spark.createDataFrame([("P1", "R1", "", "food"),
                                                         ("P2", "R3", "", "food")], schemas.PHOTO))


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_reduce_to_category(t):
    kept = C.reduce_to_category(t)
    assert ids(kept.business) == ["R1", "R2", "R5"]
    assert ids(kept.review.select("business_id").distinct(), "business_id") == ["R1", "R2", "R5"]
    assert ids(kept.checkin, "business_id") == ["R1"] and ids(kept.photo) == ["P1"]
    assert ids(kept.hours, "business_id") == ["R1"] and kept.tip.count() == 0
    assert kept.users.count() == 6
    counts = {r.table_name: (r.rows_before, r.rows_after) for r in C.table_counts(t, kept).collect()}
    assert counts["review"] == (10, 7) and counts["category"] == (8, 6)


def test_normalise_city(spark):
    rows = [("Pheonix", "99999"), ("Phx", None), ("Anthem", "85086"), ("Anthem", "85087"),
            ("Anthem", "85000"), ("Anthem", "85O01"), ("Mesa", "85001"), (None, "85001")]
    df = spark.createDataFrame(rows, "city string, postal_code string")
    got = [(r.city, r.postal_code) for r in C.normalise_city(df).collect()]
    assert got == [("Phoenix", "99999"), ("Phoenix", None), ("Phoenix", "85086"),
                   ("Anthem", "85087"), ("Anthem", "85000"), ("Anthem", "85O01"),
                   ("Mesa", "85001"), (None, "85001")]


def test_reduce_to_city(t):
    places = t.business.withColumn("city", F.when(F.col("id").isin("R1", "R2"), "Phoenix")
                                   .otherwise("Mesa"))
    kept = C.reduce_to_city(t.with_tables(business=places))
    assert ids(kept.business) == ["R1", "R2"] and kept.review.count() == 6
    assert ids(kept.users) == ["U0", "U1", "U2", "U3"]
    assert toy.rows(kept.friend) == [("U0", "U1"), ("U0", "U2"), ("U1", "U0")]
    assert kept.tip is None and set(kept.present()) == set(C.CITY_TABLES)


def test_inactive_users(t):
    assert ids(C.inactive_users(t), "user_id") == ["U8"]
    kept = C.drop_inactive(t)
    assert toy.rows(kept.friend) == [("U0", "U1"), ("U0", "U2"), ("U1", "U0"), ("U1", "U9")]
    assert ids(kept.elite_years, "user_id") == ["U0"] and "U8" not in ids(kept.users)


def test_key_checks(t):
    twice = t.with_tables(users=t.users.unionByName(t.users.where("id = 'U1'")),
                          business=t.business.where("id <> 'R1'"))
    found = {r.table_name: (r.duplicate_keys, r.duplicate_rows)
             for r in C.key_duplicates(twice).collect()}
    assert found["users"] == (1, 2) and found["review"] == (0, 0)
    lost = {r.foreign_key: (r.orphan_keys, r.orphan_rows) for r in C.key_orphans(twice).collect()}
    assert lost["review.business_id"] == (1, 3) and lost["review.user_id"] == (0, 0)


def test_category_stats(t):
    r = C.category_stats(t).collect()[0]
    assert (r.restaurants, r.food_not_restaurant_rows, r.food_and_nightlife_not_restaurant) == (3, 2, 1)
    assert (r.max_categories, r.mean_categories, r.max_reviews, r.restaurant_reviews) == (2, 2.0, 3, 7)
    assert toy.rows(C.rows_per_restaurant(t)) == [("R1", 2, 3), ("R2", 2, 3), ("R5", 2, 1)]


def test_competitors_and_prospects(spark, t):
    places = t.business.withColumn("postal_code", F.lit("85001"))
    one_zip = t.with_tables(business=places)
    seeds = toy.seeds(spark, "R1")
    comps = M.attribute_competitors(one_zip, seeds, ["Pizza", "Food"])
    assert ids(comps, "business_id") == ["R1", "R2", "R5"]
    own = M.attribute_competitors(one_zip, seeds, M.own_categories(one_zip, seeds))
    assert ids(own, "business_id") == ["R1", "R5"]
    assert toy.rows(M.new_prospects(one_zip, comps), "user_id") == [("U3",)]


def test_third_order(spark, t):
    assert ids(M.third_order_users(t, toy.seeds(spark, "R1")), "user_id") == ["U0", "U1", "U2", "U3"]
    assert ids(M.third_order_users(t, toy.seeds(spark, "R4"), followed=1), "user_id") == [
        "U0", "U1", "U2"]
    assert ids(M.third_order_businesses(t, toy.seeds(spark, "U2")), "business_id") == [
        "R1", "R2", "R3", "R4"]


def test_co_reviewers(spark, t):
    seeds = toy.seeds(spark, "U0")
    assert toy.rows(M.co_reviewers(t, seeds), "user_id", "shared") == [
        ("U0", 2), ("U1", 2), ("U2", 1), ("U3", 1)]
    assert toy.rows(M.same_rating_users(t, seeds), "user_id", "shared") == [("U0", 2), ("U1", 1)]
    seeds = toy.seeds(spark, "R1")
    assert toy.rows(M.co_reviewed(t, seeds), "business_id", "shared") == [
        ("R1", 3), ("R2", 2), ("R3", 1), ("R4", 1)]
    assert toy.rows(M.same_rating_restaurants(t, seeds), "business_id", "shared") == [("R1", 3)]


def test_named_reviewers_and_counts(spark, t):
    names = spark.createDataFrame([("u0",), ("U3",)], "name string")
    assert ids(M.named_reviewers(t, "Phoenix", names), "review_id") == [
        "U0-R1", "U0-R2", "U3-R2", "U3-R3", "U3-R5"]
    assert M.named_reviewers(t, "Mesa", names).count() == 0
    assert toy.rows(M.review_counts(t))[:2] == [("R1", 3), ("R2", 3)]
    assert toy.rows(M.edge_sample(t, k=1), "business_id", "user_id") == [
        ("R1", "U0"), ("R2", "U0"), ("R3", "U1"), ("R4", "U2"), ("R5", "U3")]
    assert toy.rows(M.busiest(t.review, "user_id")) in ([("U1",)], [("U3",)])


def test_save_load_append(spark, t, tmp_path):
    core = C.reduce_to_city(t)
    save_tables(core, str(tmp_path))
    loaded = load_tables(spark, str(tmp_path))
    assert toy.rows(loaded.review) == toy.rows(core.review)
    append_rows(loaded.friend.limit(1), str(tmp_path), "friend")
    assert load_tables(spark, str(tmp_path), names=["review", "business", "users", "friend"]
                       ).friend.count() == core.friend.count() + 1
    assert empty_like(core.review).schema == core.review.schema
    assert loaded.get("users", "U1").count() == 1 and loaded.first("users").collect()[0].id == "U0"
    loaded.register("city_")
    assert spark.sql("SELECT count(*) AS n FROM city_review").collect()[0].n == 10
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), names=["nothing"])
