"""Explicit schemas of the review data model."""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_S, _I, _L, _D, _T = StringType(), IntegerType(), LongType(), DoubleType(), TimestampType()


def _schema(required: str = "", **columns) -> StructType:
    keys = required.split()
    return StructType([StructField(name, kind, name not in keys) for name, kind in columns.items()])


# The compliment counters of a user, in the order of the data model.
COMPLIMENTS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny",
               "writer", "photos")

BUSINESS = _schema("id", id=_S, name=_S, neighborhood=_S, address=_S, city=_S, state=_S,
                   postal_code=_S, latitude=_D, longitude=_D, stars=_D, review_count=_L,
                   is_open=_I)
USERS = _schema("id", id=_S, name=_S, review_count=_L, yelping_since=_T, useful=_L, funny=_L,
                cool=_L, fans=_L, average_stars=_D,
                **{f"compliment_{kind}": _L for kind in COMPLIMENTS})
REVIEW = _schema("id user_id business_id", id=_S, stars=_L, date=_T, text=_S, useful=_L,
                 funny=_L, cool=_L, business_id=_S, user_id=_S)
FRIEND = _schema("user_id", user_id=_S, friend_id=_S)
CATEGORY = _schema("business_id category", business_id=_S, category=_S)
ATTRIBUTE = _schema("business_id name", business_id=_S, name=_S, value=_S)
CHECKIN = _schema("business_id date", business_id=_S, date=_S, count=_L)
ELITE_YEARS = _schema("user_id year", user_id=_S, year=_S)
HOURS = _schema("business_id hours", hours=_S, business_id=_S)
PHOTO = _schema("id", id=_S, business_id=_S, caption=_S, label=_S)
TIP = _schema("business_id user_id date", business_id=_S, user_id=_S, text=_S, date=_T, likes=_L)
CITIES_AND_COUNTIES = _schema(
    "id", city=_S, city_ascii=_S, state_id=_S, state_name=_S, county_name=_S, county_fips=_I,
    zip=_S, lat=DecimalType(10, 6), lng=DecimalType(10, 6), population=_I, source=_S, id=_I)

TABLES: dict[str, StructType] = {
    "attribute": ATTRIBUTE, "business": BUSINESS, "category": CATEGORY, "checkin": CHECKIN,
    "cities_and_counties": CITIES_AND_COUNTIES, "elite_years": ELITE_YEARS, "friend": FRIEND,
    "hours": HOURS, "photo": PHOTO, "review": REVIEW, "tip": TIP, "users": USERS,
}

# Primary keys and foreign keys: table -> columns, (table, column) -> (table, column).
KEYS: dict[str, tuple[str, ...]] = {
    "attribute": ("business_id", "name"), "business": ("id",),
    "category": ("business_id", "category"), "checkin": ("business_id", "date"),
    "cities_and_counties": ("id",), "elite_years": ("user_id", "year"),
    "friend": ("user_id", "friend_id"), "hours": ("business_id", "hours"), "photo": ("id",),
    "review": ("id",), "tip": ("business_id", "user_id", "date"), "users": ("id",),
}
REFERENCES: dict[tuple[str, str], tuple[str, str]] = {
    **{(child, "business_id"): ("business", "id")
       for child in ("attribute", "category", "checkin", "hours", "photo", "review", "tip")},
    **{(child, "user_id"): ("users", "id") for child in ("elite_years", "friend", "review", "tip")},
    ("friend", "friend_id"): ("users", "id"),
}

PAIR_CROSS = _schema("user_pair", row=_I, user_pair=_S, restaurant1=_S, match1=_D,
                     restaurant2=_S, match2=_D)
PAIR_LABELLED = _schema("user_pair", user_pair=_S, restaurant1=_S, match1=_D, lmu=_I)
