"""Nested documents of businesses and users, as records and as fragments.

As records, a document is its parent's record and one record for each child, all under the parent's
id: the same layout at any size, whether a parent has one review or a third of all of them.

As fragments, a document is JSON text, the children in lists below their parent, cut into parts of
bounded size: the parts of an id, put together in order, are its document. A parent with a third of
all reviews is many rows, made by many tasks; no task holds more than the units of one fragment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewgraph.functions.numbering import numbered
from reviewgraph.sources.export import as_text, records
from reviewgraph.sources.schemas import COMPLIMENTS
from reviewgraph.sources.tables import Tables

# Fields of the nested documents.
BUSINESS_FIELDS = ("name", "neighborhood", "address", "city", "state", "postal_code", "latitude",
                   "longitude", "stars", "review_count", "is_open")
USER_FIELDS = ("name", "review_count", "yelping_since", "useful", "funny", "cool", "fans",
               "average_stars", *(f"compliment_{kind}" for kind in COMPLIMENTS))
REVIEW_FIELDS = ("id", "stars", "date", "text", "useful", "funny", "cool", "business_id",
                 "user_id")
TIP_FIELDS = ("business_id", "user_id", "text", "date", "likes")

# A fragment's most units (a parent's fields, a child, or where a list begins or ends), and a
# unit's most characters; longer children are several units.
FRAGMENT_UNITS = 64
UNIT_CHARS = 16_384


def _part(rows: DataFrame, parent: str, kind: str, fields: Sequence[str]) -> DataFrame:
    """``id, kind, record``: the fields that are there as one JSON object of texts."""
    present = [f for f in fields if f in rows.columns]
    texts = as_text(rows.select(F.col(parent).alias("_parent"), *present))
    return records(texts, keep=("_parent",), fields=present).select(
        F.col("_parent").alias("id"), F.lit(kind).alias("kind"), "record")


def _of_parents(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Children whose parent is there."""
    return rows.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def business_documents(t: Tables, reviews: bool = True, attributes: bool = True,
                       hours: bool = False, checkins: bool = False,
                       categories: bool = True) -> DataFrame:
    """``id, kind, record`` of every business and its chosen children."""
    chosen = [("attribute", t.attribute, ("name", "value"), attributes),
              ("hours", t.hours, ("hours",), hours),
              ("checkin", t.checkin, ("date", "count"), checkins),
              ("category", t.category, ("category",), categories),
              ("review", t.review, REVIEW_FIELDS, reviews)]
    return _union([_part(t.business, "id", "business", BUSINESS_FIELDS)] + [
        _part(_of_parents(t.business, rows, "business_id"), "business_id", kind, fields)
        for kind, rows, fields, wanted in chosen if wanted])


def user_documents(t: Tables, reviews: bool = False, tips: bool = False) -> DataFrame:
    """``id, kind, record`` of every user and their chosen children."""
    chosen = [("review", t.review, REVIEW_FIELDS, reviews), ("tip", t.tip, TIP_FIELDS, tips)]
    return _union([_part(t.users, "id", "user", USER_FIELDS)] + [
        _part(_of_parents(t.users, rows, "user_id"), "user_id", kind, fields)
        for kind, rows, fields, wanted in chosen if wanted])


def _fragments(parents: DataFrame, fields: Sequence[str], lists: list[tuple]) -> DataFrame:
    """``id, part, fragment`` of parents with lists (name, rows, parent's key, keys, fields)."""
    head = _part(parents, "id", "", ("id", *fields))
    opened = [F.concat(F.lit("]," if k else ","), F.lit(f'"{name}":['))
              for k, (name, *_) in enumerate(lists)]
    marks = [F.expr("substring(record, 1, length(record) - 1)"), *opened,
             F.lit("]}" if lists else "}")]
    bounds = F.array(*[F.struct(F.lit(k).alias("kind"), mark.alias("text"))
                       for k, mark in enumerate(marks)])
    units = [head.select("id", F.explode(bounds).alias("_mark")).select(
        "id", "_mark.kind", F.lit(False).alias("child"), F.lit("").alias("key"), "_mark.text")]
    for k, (_, rows, parent, keys, own) in enumerate(lists, 1):
        present = [f for f in own if f in rows.columns]
        key = F.concat_ws("\0", *[F.col(c).cast("string") for c in keys]).alias("_key")
        texts = _of_parents(parents, rows, parent).select(
            F.col(parent).alias("_parent"), key,
            *[F.col(f).cast("string").alias(f) for f in present])
        units.append(records(texts, keep=("_parent", "_key"), fields=present).select(
            F.col("_parent").alias("id"), F.lit(k).alias("kind"), F.lit(True).alias("child"),
            F.col("_key").alias("key"), F.col("record").alias("text")))
    # Rows get numbers of their own, so that slices of children with equal keys stay together.
    whole = _union(units).withColumn("row", F.monotonically_increasing_id())
    last = F.floor((F.length("text") - 1) / UNIT_CHARS).cast("int")
    sliced = whole.withColumn("slice", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "text", F.substring(F.col("text"), F.col("slice") * UNIT_CHARS + 1, F.lit(UNIT_CHARS)))
    in_order = numbered(sliced, [F.col(c) for c in ("id", "kind", "child", "key", "row", "slice")],
                        drop=("key", "row"))

    block = F.floor((F.col("number") - 1) / FRAGMENT_UNITS)
    first_child = F.col("child") & (F.col("slice") == 0)
    unit = F.struct("number", "id", "child", first_child.alias("begins"), "text")
    # A block's last unit is told to the next one too, whose first child may follow another.
    seen = F.when(F.col("number") % FRAGMENT_UNITS == 0, F.array(block, block + 1)).otherwise(
        F.array(block))
    # Where a document begins is told to all blocks it is in, so that texts move once, by block.
    spans = in_order.select("id", block.alias("block")).distinct().withColumn(
        "start", F.struct("id", F.min("block").over(Window.partitionBy("id")).alias("first")))
    rows = (in_order.select(F.explode(seen).alias("block"), unit.alias("unit"))
            .unionByName(spans.select("block", "start"), allowMissingColumns=True))
    gathered = rows.groupBy("block").agg(
        F.array_sort(F.collect_list("unit")).alias("units"),
        F.map_from_entries(F.collect_list("start")).alias("firsts"))
    comma = F.transform("units", lambda u, i: F.struct(
        u["number"].alias("number"), u["id"].alias("id"),
        F.element_at("firsts", u["id"]).alias("first"),
        F.concat(F.when(u["begins"] & F.coalesce(F.get("units", i - 1)["child"], F.lit(False)),
                        ",").otherwise(""), u["text"]).alias("text")))
    parts = (gathered.select("block", F.explode(comma).alias("_unit")).select("block", "_unit.*")
             .where(F.col("block") == block).groupBy("block", "id")
             .agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("texts"),
                  F.min("first").alias("first")))
    return parts.where(F.col("id").isNotNull()).select(
        "id", (F.col("block") - F.col("first")).alias("part"),
        F.array_join("texts.text", "").alias("fragment"))


def nested_business_documents(t: Tables, reviews: bool = True, attributes: bool = True,
                              hours: bool = False, checkins: bool = False,
                              categories: bool = True) -> DataFrame:
    """``id, part, fragment``: the JSON document of every business with its chosen children."""
    lists = [("reviews", t.review, ("id",), REVIEW_FIELDS, reviews),
             ("attributes", t.attribute, ("name",), ("name", "value"), attributes),
             ("hours", t.hours, ("hours",), ("hours",), hours),
             ("checkins", t.checkin, ("date",), ("date", "count"), checkins),
             ("categories", t.category, ("category",), ("category",), categories)]
    return _fragments(t.business, BUSINESS_FIELDS, [
        (name, rows, "business_id", keys, fields) for name, rows, keys, fields, wanted in lists
        if wanted])


def nested_user_documents(t: Tables, reviews: bool = False, tips: bool = False) -> DataFrame:
    """``id, part, fragment``: the JSON document of every user with their chosen children."""
    lists = [("reviews", t.review, ("id",), REVIEW_FIELDS, reviews),
             ("tips", t.tip, ("business_id", "date"), TIP_FIELDS, tips)]
    return _fragments(t.users, USER_FIELDS, [
        (name, rows, "user_id", keys, fields) for name, rows, keys, fields, wanted in lists
        if wanted])


def review_by_id(t: Tables, user_id: str, review_id: str) -> DataFrame:
    """A user's review with this id."""
    return t.review.where((F.col("user_id") == user_id) & (F.col("id") == review_id))


def reviewed_businesses(t: Tables) -> DataFrame:
    """The distinct businesses each user reviewed."""
    return t.review.select("user_id", "business_id").distinct()
