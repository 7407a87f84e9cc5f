"""Reading and writing the exchange formats: csv with a header, and JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep, encoding="utf-8")


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.csv(path, header=True, sep=sep, encoding="utf-8", mode=mode)


def records(df: DataFrame, keep: Sequence[str] = (),
            fields: Sequence[str] = ("*",)) -> DataFrame:
    """Every row's fields as one JSON object in column ``record``; ``keep`` names columns to keep.
    """
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(*keep, body.alias("record"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    df.write.json(path, mode=mode, ignoreNullFields=False)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as a string."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
