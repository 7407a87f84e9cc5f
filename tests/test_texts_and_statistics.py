import itertools
import json
import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from reviewgraph.functions import display
from reviewgraph.operators import documents as D
from reviewgraph.operators import profiles as P
from reviewgraph.operators import validation as V
from reviewgraph.operators.momentum import momentum
from reviewgraph.operators.search import full_list, search
from reviewgraph.operators.sentiment import TOKENS, sentiment, sentiment_by_stars, words
from reviewgraph.sources import schemas
from reviewgraph.sources.export import as_text, read_csv, write_csv
from tests import toy


@pytest.fixture(scope="module")
def t(spark):
    return toy.tables(spark)


@pytest.fixture(scope="module")
def matrix_rows():
    rng = random.Random(3)
    return [("S", f"name {b}", f"B{b}", f"U{u:02d}", rng.randint(1, 5))
            for u in range(40) for b in range(6) if b == 0 or rng.random() < .5]


@pytest.fixture(scope="module")
def matrix(spark, matrix_rows):
    return spark.createDataFrame(
        matrix_rows, "seed_id string, restaurant string, rest_id string, user_id string, rating long")


def listed_pairs(rows):
    by_rest = defaultdict(list)
    for _, _, rest, user, rating in rows:
        by_rest[rest].append((user, rating))
    for rest, raters in by_rest.items():
        for (u, a), (v, b) in itertools.combinations(sorted(raters), 2):
            yield rest, u, v, round(min(a, b) / max(a, b), 4)


def test_pair_classes_count_the_listed_pairs(matrix, matrix_rows):
    want = Counter((rest, m) for rest, _, _, m in listed_pairs(matrix_rows))
    got = {(r.rest_id, r.rating_match): r.pairs for r in V.pair_classes(matrix).collect()}
    assert got == dict(want)


def test_pair_cross_and_correlation(matrix, matrix_rows):
    match = defaultdict(dict)
    for rest, u, v, m in listed_pairs(matrix_rows):
        match[u, v][rest] = m
    cross = [(a, b, rests[a], rests[b]) for rests in match.values()
             for a, b in itertools.combinations(sorted(rests), 2)]
    classes = V.pair_cross_classes(matrix)
    got = {(r.rest_id1, r.rest_id2, r.match1, r.match2): r.pairs for r in classes.collect()}
    assert got == dict(Counter(cross))
    stats = V.pair_corr(classes, "pairs").collect()[0]
    x, y = np.array([c[2] for c in cross]), np.array([c[3] for c in cross])
    assert stats.n == len(cross)
    assert stats["corr"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
    assert stats.mean1 == pytest.approx(x.mean(), abs=1e-6)


def test_anova_by_look_alike_label(spark, matrix, matrix_rows):
    like_pairs = {("U01", "U02"), ("U05", "U03"), ("U03", "U05"), ("U10", "U20"), ("U99", "U01")}
    like = spark.createDataFrame(sorted(like_pairs), "seed_id string, user_id string")
    alike = {tuple(sorted(p)) for p in like_pairs}
    groups = {0: [], 1: []}
    for _, u, v, m in listed_pairs(matrix_rows):
        groups[int((u, v) in alike)].append(m)
    labelled = V.labelled_classes(matrix, like)
    means = {r.lmu: (r.n, r["mean"]) for r in V.pair_means(labelled, "pairs").collect()}
    for label, values in groups.items():
        assert means[label] == (len(values), pytest.approx(np.mean(values), abs=1e-6))
    every = np.array(groups[0] + groups[1])
    between = sum(len(v) * (np.mean(v) - every.mean()) ** 2 for v in groups.values())
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    r = V.pair_anova(labelled, "pairs").collect()[0]
    assert (r.df_between, r.df_within) == (1, len(every) - 2)
    assert r.f == pytest.approx(between / (within / (len(every) - 2)), abs=1e-5)
    assert r.ss_within == pytest.approx(within, abs=1e-5)
    box = {q.lmu: q for q in V.quartiles(labelled, "match", weight="pairs").collect()}
    for label, values in groups.items():
        assert [box[label].q1, box[label].median, box[label].q3] == pytest.approx(
            list(np.percentile(values, [25, 50, 75])), abs=1e-6)


def test_rating_matrix(spark, t):
    got = toy.rows(V.rating_matrix(t, toy.seeds(spark, "R1"), k=2), "rest_id", "user_id", "rating")
    assert got == [("R1", "U0", 5), ("R1", "U1", 4), ("R1", "U2", 2), ("R2", "U0", 3), ("R2", "U1", 3)]


def test_listed_look_alike_pairs(spark, t):
    like = spark.createDataFrame(
        [("U0", "U1", "R1", "R1", 5), ("U0", "U1", "R2", "R2", 3), ("U1", "U0", "R1", "R1", 4)],
        "seed_id string, user_id string, restaurant_id string, restaurant string, sel_rating long")
    pairs = V.user_pairs(t, like)
    assert toy.rows(pairs, "user_pair", "rest_id", "rating_match") == [
        ("U0+++U1", "R1", .8), ("U0+++U1", "R2", 1.0)]
    cross = V.pair_cross(pairs)
    assert toy.rows(cross) == [("U0+++U1", "R1", .8, "R2", 1.0)]
    assert toy.rows(V.pair_long(cross)) == [("U0+++U1", "R1", .8), ("U0+++U1", "R2", 1.0)]


def test_pairs_from_a_csv_file(spark, tmp_path):
    rows = [(0, "a+++b", "X", .5, "Y", 1.0), (1, "a+++c", "X", .25, "Y", .5), (2, "b+++c", "X", 1.0, "Y", .6)]
    write_csv(spark.createDataFrame(rows, schemas.PAIR_CROSS), str(tmp_path / "p"), sep="\t")
    back = read_csv(spark, str(tmp_path / "p"), schemas.PAIR_CROSS, sep="\t")
    assert toy.rows(back) == rows
    r = V.pair_corr(back).collect()[0]
    assert r["corr"] == pytest.approx(np.corrcoef([.5, .25, 1.0], [1.0, .5, .6])[0, 1], abs=1e-6)
    assert V.pair_long(back).count() == 6


def test_sentiment(spark):
    texts = [(1, "Good, GOOD food but bad service!"), (2, ""), (3, "just food"), (4, None),
             (5, "bad")]
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    got = {r.id: r for r in sentiment(
        spark.createDataFrame(texts, "id int, text string"), lexicon).collect()}
    up, down, flat = 2 * 2.9, 3.5, 3
    total = up + down + flat
    assert got[1].n_words == 6
    assert (got[1].pos, got[1].neg, got[1].neu) == tuple(round(x / total, 3) for x in (up, down, flat))
    assert got[1].compound == round(1.3 / math.sqrt(1.3 ** 2 + 15), 4)
    assert (got[2].n_words, got[2].pos, got[2].neu, got[2].compound) == (0, 0.0, 0.0, 0.0)
    assert got[4].n_words == 0 and got[3].neu == 1.0
    assert got[5].compound == round(-2.5 / math.sqrt(2.5 ** 2 + 15), 4)
    scored = spark.createDataFrame([(1, .1, .5, .4), (1, .3, .5, .2), (2, .0, 1.0, .0)],
                                   "stars int, neg double, neu double, pos double")
    box = {(r.stars, r.share): r.median for r in sentiment_by_stars(scored).collect()}
    assert box[1, "neg"] == pytest.approx(.2) and box[2, "neu"] == 1.0 and len(box) == 6


def test_momentum(spark):
    day = datetime(2018, 1, 1, 10)
    rows = [("R", 5, day), ("R", 2, day + timedelta(hours=3)), ("R", 1, day + timedelta(days=2)),
            ("Q", 4, day)]
    df = spark.createDataFrame(rows, "business_id string, stars long, date timestamp")
    assert toy.rows(momentum(df), "business_id", "reviews", "daily_mean", "expanding_mean") == [
        ("Q", 1, 4.0, 4.0), ("R", 1, 1.0, 2.25), ("R", 2, 3.5, 3.5)]


def documents(df):
    """``{id: {kind: [record, ...]}}``"""
    out = {}
    for r in df.collect():
        out.setdefault(r.id, {}).setdefault(r.kind, []).append(json.loads(r.record))
    return out


def test_business_documents(spark, t):
    full = t.with_tables(
        hours=spark.createDataFrame([("Mon 9-17", "R1"), ("Sun 1-2", "LOST")], schemas.HOURS),
        checkin=spark.createDataFrame([("R1", "Fri-9", 2)], schemas.CHECKIN))
    docs = documents(D.business_documents(full, hours=True, checkins=True))
    assert sorted(docs) == ["R1", "R2", "R3", "R4", "R5"]
    one = docs["R1"]
    assert sorted(x["id"] for x in one["review"]) == ["U0-R1", "U1-R1", "U2-R1"]
    assert {x["id"]: x["text"] for x in one["review"]}["U0-R1"] == "text U0 R1"
    assert sorted((a["name"], a["value"]) for a in one["attribute"]) == [
        ("Alcohol", "1"), ("Parking", "0"), ("WiFi", "1")]
    assert one["hours"] == [{"hours": "Mon 9-17"}]
    assert one["checkin"] == [{"date": "Fri-9", "count": "2"}]
    assert one["business"][0]["name"] == "R1" and one["business"][0]["latitude"] is None
    assert "category" not in docs["R4"] and "checkin" not in docs["R4"]
    assert {k for d in documents(D.business_documents(full, reviews=False)).values() for k in d} \
        == {"business", "attribute", "category"}


def test_documents_have_one_layout_at_any_size(spark, t):
    reviews = [(f"U{n}", "R1", 3, 0) for n in range(3000)] + [("U0", "R2", 1, 0)]
    many = t.with_tables(review=toy.review(spark, reviews))
    docs = documents(D.business_documents(many))
    assert len(docs["R1"]["business"]) == len(docs["R2"]["business"]) == 1
    assert {x["id"] for x in docs["R1"]["review"]} == {f"U{n}-R1" for n in range(3000)}
    assert len(docs["R2"]["review"]) == 1


def test_user_documents(spark, t):
    tips = spark.createDataFrame([("R4", "U1", "go", toy.DAY, 1)], schemas.TIP)
    docs = documents(D.user_documents(t.with_tables(tip=tips), reviews=True, tips=True))
    assert sorted(x["id"] for x in docs["U1"]["review"]) == ["U1-R1", "U1-R2", "U1-R3"]
    assert docs["U1"]["tip"][0]["text"] == "go" and "tip" not in docs["U0"]
    assert {k for d in documents(D.user_documents(t)).values() for k in d} == {"user"}
    assert D.review_by_id(t, "U1", "U1-R2").count() == 1
    assert D.review_by_id(t, "U0", "U1-R2").count() == 0
    assert D.reviewed_businesses(t).where("user_id = 'U1'").count() == 3


def test_rows_by_key(t):
    assert t.get("users", "U1").first().id == "U1"
    assert t.get("category", "R2", "Food").count() == 1
    assert tuple(t.first("category").first()) == ("R1", "Pizza")
    with pytest.raises(ValueError):
        t.get("category", "R2")


def test_tokens_with_apostrophes_and_emoticons(spark):
    rows = spark.createDataFrame([("Isn't it well-made? :-) no :(",)], "text string")
    got = [r[0] for r in rows.select(words(rows.text, TOKENS)).collect()]
    assert got == [["isn't", "it", "well-made", ":-)", "no", ":("]]
    assert rows.select(words(rows.text)).first()[0] == ["isn", "t", "it", "well", "made", "no"]


def test_staged_tables_are_shared_and_released(spark):
    from reviewgraph.sources import staging

    folder = staging.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = staging.staged(spark.range(3), "kept")
    assert folder in kept.inputFiles()[0] and kept.count() == 3


def test_search(spark):
    rows = [("1", "Pasta Bar", "x"), ("2", "pasta%", "y"), ("3", "The Pasta", "z"), ("4", "PASTA", None)]
    df = spark.createDataFrame(rows, "id string, name string, address string")
    assert [r.id for r in search(df, "pAsTa").collect()] == ["4", "1", "2"]
    assert [r.name for r in search(df, "pasta%").collect()] == ["pasta% (y)"]
    assert search(df, "p", limit=2).count() == 2
    assert toy.rows(full_list(df).where("restaurant is not null"))[0] == ("Pasta Bar (x)", "1")


def test_rating_card_and_number_formats(spark, t):
    pairs = spark.createDataFrame([("U0", "R1")], "user_id string, restaurant_id string")
    card = display.rating_card(P.user_restaurant_rating(t, pairs)).collect()[0]
    assert (card.rating, card.date, card.review) == ("★★★★★", "2018-03-01", "text U0 R1")
    values = spark.createDataFrame([(x,) for x in (3.5, 16.2, 3.24, .45, 100.0, 9.96, 99.6, 0.0, 0.064)],
                                   "x double")
    got = [r[0] for r in values.select(display.two_significant(values.x)).collect()]
    assert got == ["3.5", "16", "3.2", "0.45", "1.0e+2", "10", "1.0e+2", "0.0", "0.064"]
    assert values.select(display.stars_text(values.x)).first()[0] == "★★★½"
    assert values.select(display.two_digits(values.x)).first()[0] == "3.50"
    millis = spark.sql("SELECT 1519862400000 AS ms")
    assert str(millis.select(display.date_from_millis(millis.ms)).first()[0]) == "2018-03-01"
    assert as_text(values).schema["x"].dataType.simpleString() == "string"
