"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that name a folder which driver and executors share; the first one that is set counts.
SHARED = ("spark.checkpoint.dir", "spark.sql.warehouse.dir")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _session_name(spark: SparkSession) -> str:
    return "llm_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)


def session_folder(spark: SparkSession) -> str:
    """This session's folder below the shared one; without spark.checkpoint.dir, the warehouse."""
    base = next(x for x in (spark.conf.get(name, None) for name in SHARED) if x)
    return f"{base.rstrip('/')}/{_session_name(spark)}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder path below the session's."""
    return f"{session_folder(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this session's operators have written; frames that read it end with it.

    For use when results are stored elsewhere: a result reads its intermediate tables until then.
    """
    for kept in spark.catalog.listTables(pattern=f"{_session_name(spark)}_*"):
        spark.sql(f"DROP TABLE IF EXISTS {kept.name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they are done."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder, read back without their lineage.

    The shuffle files of the writing job are not needed any more and are cleaned with it.
    """
    path = shared_folder(df.sparkSession)
    with _cleaned_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows written as a table in buckets of a key: joins on the key don't move them again."""
    spark = df.sparkSession
    name = f"{_session_name(spark)}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaned_shuffles(spark):
        (df.repartition(n, key).write.bucketBy(n, key).option("path", shared_folder(spark))
         .saveAsTable(name))
    return spark.table(name)


def one_text_per_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (long) and text of the rows with an id; of rows with one id, the text sorted last.

    Texts are moved only if any id is repeated.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = rows.groupBy("doc_id").count().where(F.col("count") > 1)
    if repeated.isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"))
