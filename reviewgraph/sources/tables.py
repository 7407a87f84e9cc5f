"""The table catalog handed to every operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewgraph.functions.ranking import top_k
from reviewgraph.sources.schemas import KEYS, TABLES
from reviewgraph.sources.staging import staged


@dataclass(frozen=True)
class Tables:
    """The review tables as DataFrames.

    ``one_review_per_pair`` states that ``review`` holds at most one row per (user, business);
    it saves the de-duplicating shuffle in :meth:`ratings`.
    """

    review: DataFrame
    business: DataFrame
    users: DataFrame
    friend: DataFrame
    category: DataFrame | None = None
    attribute: DataFrame | None = None
    tip: DataFrame | None = None
    elite_years: DataFrame | None = None
    checkin: DataFrame | None = None
    hours: DataFrame | None = None
    photo: DataFrame | None = None
    cities_and_counties: DataFrame | None = None
    one_review_per_pair: bool = False
    edges: DataFrame | None = None

    def present(self) -> dict[str, DataFrame]:
        """Name and frame of every table that was given."""
        return {f.name: getattr(self, f.name) for f in fields(self)
                if f.name in TABLES and getattr(self, f.name) is not None}

    def with_tables(self, **frames: DataFrame) -> Tables:
        """The same catalog with some tables replaced."""
        edges = None if "review" in frames else self.edges
        return replace(self, **{"edges": edges, **frames})

    def prepared(self) -> Tables:
        """Write :meth:`ratings` once, for several operators that follow."""
        return self if self.edges is not None else replace(
            self, edges=staged(self.ratings(), "ratings"))

    def ratings(self, of: DataFrame | None = None) -> DataFrame:
        """``user_id, business_id, stars, useful``: the latest review of every pair.

        ``of``, a frame with one of the two ids, names whose ratings are wanted; they are picked
        before anything else is done. Reviews by users or of businesses that are not there are
        left out, as in a join with both. The text never enters the joins of the scoring
        operators.
        """
        def picked(rows: DataFrame) -> DataFrame:
            return rows if of is None else rows.join(of, of.columns[0], "left_semi")

        if self.edges is not None:
            return picked(self.edges)
        thin = picked(self.review.select("user_id", "business_id", "stars", "useful", "date",
                                         "id"))
        thin = (thin.join(self.users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
                .join(self.business.select(F.col("id").alias("business_id")), "business_id",
                      "left_semi"))
        if not self.one_review_per_pair:
            thin = top_k(thin, ["user_id", "business_id"], [F.desc("date"), F.desc("id")], 1)
        return thin.select("user_id", "business_id", "stars", "useful")

    def staged(self, *names: str, folder: str | None = None) -> Tables:
        """Write the named tables (default: all) to a folder and use those copies."""
        chosen = names or tuple(self.present())
        return replace(self, **{name: staged(getattr(self, name), name, folder)
                                for name in chosen})

    def register(self, prefix: str = "") -> None:
        """Make every table available to ``spark.sql`` under its name."""
        for name, df in self.present().items():
            df.createOrReplaceTempView(prefix + name)

    def get(self, table: str, *key: object) -> DataFrame:
        """The row with this primary key, its values in the order of the table's key columns."""
        columns = KEYS[table]
        if len(key) != len(columns):
            raise ValueError(f"the key of {table} is {columns}")
        rows = getattr(self, table)
        for column, value in zip(columns, key):
            rows = rows.where(F.col(column) == F.lit(value))
        return rows

    def first(self, table: str) -> DataFrame:
        """The row with the smallest primary key."""
        return getattr(self, table).orderBy(*KEYS[table]).limit(1)


# The tables that remain after a reduction to one city.
CORE_TABLES = ("attribute", "business", "category", "friend", "review", "users")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str] = CORE_TABLES,
                fmt: str = "parquet", one_review_per_pair: bool = False,
                **options: str) -> Tables:
    """Read one dataset per table from ``folder``, with the fixed schemas."""
    unknown = set(names) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    frames = {name: spark.read.format(fmt).options(**options).schema(TABLES[name])
              .load(f"{folder.rstrip('/')}/{name}") for name in names}
    return Tables(one_review_per_pair=one_review_per_pair, **frames)


def load_jdbc(spark: SparkSession, url: str, names: Mapping[str, str],
              one_review_per_pair: bool = False, **options: str) -> Tables:
    """Read the tables from a relational database; ``names`` maps table name to database table.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` through
    ``options`` for parallel reads.
    """
    frames = {name: spark.read.format("jdbc").options(url=url, dbtable=source, **options).load()
              for name, source in names.items()}
    return Tables(one_review_per_pair=one_review_per_pair, **frames)


def save_tables(t: Tables, folder: str, mode: str = "errorifexists") -> None:
    for name, df in t.present().items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def append_rows(df: DataFrame, folder: str, table: str) -> None:
    """Append rows to a stored table."""
    df.select(*TABLES[table].fieldNames()).write.mode("append").parquet(
        f"{folder.rstrip('/')}/{table}")


def empty_like(df: DataFrame) -> DataFrame:
    """An empty table with the same columns."""
    return df.sparkSession.createDataFrame([], df.schema)
