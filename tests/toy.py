"""Hand-made tables with hand-computed results."""

from datetime import datetime

from reviewgraph.sources import schemas
from reviewgraph.sources.tables import Tables

DAY = datetime(2018, 3, 1)

# id, review_count, votes, fans, average_stars
USERS = [("U0", 3, 7, 2, 3.67), ("U1", 10, 100, 5, 4.0), ("U2", 1, 0, 0, 5.0),
         ("U3", 40, 30, 1, 3.0)]
FRIENDS = [("U0", "U1"), ("U0", "U2"), ("U1", "U0")]
# id, postal_code, stars, review_count
BUSINESS = [("R1", "85001", 4.0, 3), ("R2", "85001", 3.5, 4), ("R3", "85002", 4.5, 2),
            ("R4", "85002", 3.0, 1), ("R5", "85003", 5.0, 1)]
# user, business, stars, useful
REVIEWS = [("U0", "R1", 5, 0), ("U0", "R2", 3, 2), ("U1", "R1", 4, 1), ("U1", "R2", 3, 0),
           ("U1", "R3", 5, 3), ("U2", "R1", 2, 0), ("U2", "R4", 4, 1), ("U3", "R2", 1, 0),
           ("U3", "R3", 3, 0), ("U3", "R5", 5, 0)]
CATEGORIES = [("R1", "Restaurants"), ("R1", "Pizza"), ("R2", "Restaurants"), ("R2", "Food"),
              ("R3", "Food"), ("R3", "Bars"), ("R5", "Restaurants"), ("R5", "Pizza")]
ATTRIBUTES = [("R1", "WiFi", "1"), ("R1", "Parking", "0"), ("R1", "Alcohol", "1"),
              ("R2", "Parking", "0")]


def frame(spark, schema, rows, columns):
    """A frame with the full schema from rows that give only some columns."""
    names = [f.name for f in schema.fields]
    full = [tuple(dict(zip(columns, row)).get(n) for n in names) for row in rows]
    return spark.createDataFrame(full, schema)


def users(spark, rows):
    return frame(spark, schemas.USERS, [(i, i, n, v, 0, 0, f, s) for i, n, v, f, s in rows],
                 ["id", "name", "review_count", "useful", "funny", "cool", "fans",
                  "average_stars"])


def business(spark, rows):
    return frame(spark, schemas.BUSINESS,
                 [(i, i, f"{i} street", "Phoenix", z, s, n) for i, z, s, n in rows],
                 ["id", "name", "address", "city", "postal_code", "stars", "review_count"])


def review(spark, rows):
    return frame(spark, schemas.REVIEW,
                 [(f"{u}-{b}", u, b, s, n, 0, 0, DAY, f"text {u} {b}") for u, b, s, n in rows],
                 ["id", "user_id", "business_id", "stars", "useful", "funny", "cool", "date",
                  "text"])


def tables(spark, reviews=None, people=None, places=None, friends=None) -> Tables:
    return Tables(
        review=review(spark, REVIEWS if reviews is None else reviews),
        business=business(spark, BUSINESS if places is None else places),
        users=users(spark, USERS if people is None else people),
        friend=spark.createDataFrame(FRIENDS if friends is None else friends, schemas.FRIEND),
        category=spark.createDataFrame(CATEGORIES, schemas.CATEGORY),
        attribute=spark.createDataFrame(ATTRIBUTES, schemas.ATTRIBUTE)).staged()


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed_id string")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
