"""Nested documents in fragments of bounded size."""

import json

import pytest
from pyspark.sql import functions as F

from reviewgraph.functions import numbering
from reviewgraph.operators import documents as D
from reviewgraph.sources import schemas
from tests import toy

ODD = 'say "no"\n\\ é 中 \t,]}'


@pytest.fixture(scope="module")
def t(spark):
    full = toy.tables(spark)
    review = full.review.withColumn("text", F.when(F.col("id") == "U0-R1", ODD).otherwise(
        F.col("text")))
    lost = review.where("id = 'U0-R1'").withColumns({"id": F.lit("X"), "business_id": F.lit("NO"),
                                                     "user_id": F.lit("NOBODY")})
    return full.with_tables(
        review=review.unionByName(lost),
        hours=spark.createDataFrame([("Mon 9-17", "R1"), ("Sun 1-2", "R1"), ("Sat", "LOST")],
                                    schemas.HOURS),
        checkin=spark.createDataFrame([("R1", "Fri-9", 2)], schemas.CHECKIN),
        tip=spark.createDataFrame([("R4", "U1", "go", toy.DAY, 1)], schemas.TIP)).staged()


def documents(df):
    """The parsed document of each id; its parts are numbered from 0 on."""
    parts = {}
    for r in df.collect():
        parts.setdefault(r["id"], {})[r["part"]] = r["fragment"]
    assert all(sorted(p) == list(range(len(p))) for p in parts.values())
    return {i: json.loads("".join(p[k] for k in sorted(p))) for i, p in parts.items()}


def nested(parents, fields, lists):
    """The same from plain rows: names of lists to rows, parent's key, order and fields."""
    def text(row, names):
        return {f: None if row[f] is None else str(row[f]) for f in names}

    out = {}
    for p in parents.collect():
        out[p["id"]] = text(p, ("id", *fields)) | {
            name: [text(c, own) for c in sorted(rows.collect(), key=lambda c: str(c[order]))
                   if c[key] == p["id"]] for name, (rows, key, order, own) in lists.items()}
    return out


def business_lists(t):
    return {"reviews": (t.review, "business_id", "id", D.REVIEW_FIELDS),
            "attributes": (t.attribute, "business_id", "name", ("name", "value")),
            "hours": (t.hours, "business_id", "hours", ("hours",)),
            "checkins": (t.checkin, "business_id", "date", ("date", "count")),
            "categories": (t.category, "business_id", "category", ("category",))}


@pytest.mark.parametrize("chosen", [
    (), ("reviews",), ("attributes",), ("hours",), ("checkins",), ("categories",),
    ("reviews", "attributes", "hours", "checkins", "categories")])
def test_business_documents_with_any_children(t, monkeypatch, chosen):
    monkeypatch.setattr(D, "FRAGMENT_UNITS", 3)
    lists = business_lists(t)
    got = documents(D.nested_business_documents(t, **{n: n in chosen for n in lists}))
    want = nested(t.business, D.BUSINESS_FIELDS, {n: lists[n] for n in lists if n in chosen})
    assert got == want and (not chosen or all(list(d)[-1] == chosen[-1] for d in got.values()))


@pytest.mark.parametrize("reviews", [False, True])
@pytest.mark.parametrize("tips", [False, True])
def test_user_documents_with_any_children(t, reviews, tips):
    lists = {"reviews": (t.review, "user_id", "id", D.REVIEW_FIELDS),
             "tips": (t.tip, "user_id", "date", D.TIP_FIELDS)}
    wanted = {n: v for n, v in lists.items() if {"reviews": reviews, "tips": tips}[n]}
    got = documents(D.nested_user_documents(t, reviews=reviews, tips=tips))
    assert got == nested(t.users, D.USER_FIELDS, wanted)


def test_a_hot_parent_is_many_bounded_rows(spark, t, monkeypatch):
    monkeypatch.setattr(D, "UNIT_CHARS", 300)
    reviews = [(f"U{n}", "R1", 3, 0) for n in range(2000)] + [("U0", "R2", 1, 0)]
    rows = toy.review(spark, reviews).withColumn("text", F.when(
        F.col("id") == "U7-R1", F.repeat(F.lit("long "), 500)).otherwise(F.col("text")))
    out = D.nested_business_documents(t.with_tables(review=rows)).cache()
    sizes = {r["id"]: r for r in out.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("fragment")).alias("most")).collect()}
    assert sizes["R1"]["n"] >= 2000 // D.FRAGMENT_UNITS and sizes["R2"]["n"] <= 2
    assert all(r["most"] <= D.FRAGMENT_UNITS * (300 + 1) for r in sizes.values())
    docs = documents(out)
    assert [r["id"] for r in docs["R1"]["reviews"]] == sorted(f"U{n}-R1" for n in range(2000))
    assert {r["id"]: r["text"] for r in docs["R1"]["reviews"]}["U7-R1"] == "long " * 500


def test_equal_long_children_and_empty_tables(spark, t, monkeypatch):
    monkeypatch.setattr(D, "UNIT_CHARS", 50)
    twice = t.review.where("id = 'U1-R3'")
    docs = documents(D.nested_business_documents(t.with_tables(
        review=twice.unionByName(twice)), attributes=False, categories=False))
    assert len(docs["R3"]["reviews"]) == 2 and docs["R1"]["reviews"] == []
    none = t.with_tables(business=t.business.limit(0))
    assert D.nested_business_documents(none).collect() == []


def test_texts_move_once_after_numbering(t, spark):
    """Where a document begins is told to its blocks; no join takes the texts to it."""
    plan = D.nested_business_documents(t)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("BroadcastHashJoin [_part", "")
    assert sum("Exchange hashpartitioning(block" in x for x in plan.split("\n")) == 1


def test_columns_for_the_order_only_are_not_written(spark, monkeypatch):
    written = []
    real = numbering.staged
    monkeypatch.setattr(numbering, "staged",
                        lambda df, name: written.append(df.columns) or real(df, name))
    rows = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "id string, at int")
    got = numbering.numbered(rows, [F.col("at")], drop=("at",)).collect()
    assert {r["id"]: r["number"] for r in got} == {"b": 1, "a": 2, "c": 3}
    assert written == [["id", "_at"]]
